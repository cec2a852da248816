"""Folders, repositories and tables to packed documents: sources, rendering, shards, clusters, sinks."""

import os
import random
import subprocess

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillpack.model import Settings
from quillpack.operators import cluster, content, filters, render, shard, sinks
from quillpack.operators.rows import file_rows
from quillpack.plans.pack import pack, pack_many
from quillpack.sources import files


def git(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


def write(root, tree):
    for name, body in tree.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())


def rows_of(spark, contents, repo=""):
    source = spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(contents.items())], "k long, p string, c string")
    return file_rows(source, F.col("p"), F.col("k"), F.col("c"), repo=F.lit(repo))


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, {"b.cs": "class B { }  \n\n", "src/a.py": "x = 1 # one\n", "node_modules/m.js": "no", "src/bin.txt": b"a\0b", "bom.txt": b"\xef\xbb\xbfhi", "bad.txt": b"a\xffb", ".hidden": "h"})
    return tmp_path


def test_folder_to_document(spark, folder):
    rows = files.scan_folder(spark, str(folder), Settings(discovery="filesystem"))
    doc = pack(rows, extensions=("cs", "py")).document.first().document
    assert doc == (
        "## File: b.cs\n````cs\nclass B { }\n````\n\n## File: src/a.py\n````python\nx = 1 # one\n````\n\n"
        "_Project Structure:_ \n```text\nb.cs\nsrc/a.py\n```\n\n"
    )


def test_contents_are_decoded_and_failures_are_rows(spark, folder):
    got = {r.relative: r for r in pack(files.scan_folder(spark, str(folder), Settings(discovery="filesystem"))).rows.collect()}
    assert got["bom.txt"].content == "hi" and got["bad.txt"].content == "a�b" and got["src/bin.txt"].status == "binary" and ".hidden" in got and "node_modules/m.js" not in got
    assert got["src/bin.txt"].section == "[Skipping binary file: src/bin.txt]\n"
    gone = spark.createDataFrame([(0, "", str(folder), "gone.txt", None)], files._LISTED)
    assert files.read_contents(gone, 10).first().error and content.with_status(file_rows(files.read_contents(gone, 10), F.col("path"), F.col("ord"), F.col("content"), F.col("size"), error=F.col("error")), 10).first().status == "error"


def test_git_discovery_and_changes(spark, folder):
    with pytest.raises(files.DiscoveryError):
        files.git_files(str(folder))
    write(folder, {".gitignore": "*.log\n", "x.log": "log"})
    git(folder, "init", "-q")
    git(folder, "add", "-A")
    git(folder, "commit", "-qm", "one")
    names = files.discover(str(folder))
    assert "src/a.py" in names and "x.log" not in names and "src/a.py" not in files.git_files(str(folder), 0)
    write(folder, {"b.cs": "class C { }"})
    assert files.changed_files(str(folder), "HEAD") == ["b.cs"]
    assert [r.relative for r in files.scan_folder(spark, str(folder), since="HEAD").collect()] == ["b.cs"]
    for ref in ("", "-x"):
        with pytest.raises(files.DiscoveryError):
            files.changed_files(str(folder), ref)


def test_walk_skips_links_and_cycles(folder):
    os.symlink(folder, folder / "src" / "loop")
    assert files.walk_files(str(folder), max_depth=0) == sorted(["b.cs", "bom.txt", "bad.txt", ".hidden"])
    assert len(files.walk_files(str(folder), follow_symlinks=True)) == len(files.walk_files(str(folder)))


def test_binary_source(spark, folder):
    got = {r.relative: r.content for r in files.scan_binary_files(spark, f"file://{folder}").collect()}
    assert got["b.cs"].startswith("class B") and got["bom.txt"] == "hi" and got["bad.txt"] == "a�b" and "node_modules/m.js" not in got
    short = files.scan_binary_files(spark, f"file://{folder}", max_file_size=5)
    rows = {r.relative: r for r in content.with_status(short, 5).collect()}
    assert rows["b.cs"].content is None and rows["b.cs"].size == 15 and rows["b.cs"].status == "oversize" and rows["bom.txt"].content == "hi" and len(rows) == len(got)
    assert [r.relative for r in filters.first_files(short, 2).collect()] == sorted(got)[:2]


def test_changes_between_tables(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3"), ("e", None)], "relative string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "1"), (None, "3"), ("e", ""), ("b", "2")], "relative string, content string")
    assert sorted(map(str, files.changed_since(old, new).collect())) == sorted(map(str, new.where("relative IS NULL OR relative = 'c' OR content = '3' AND relative = 'b'").collect()))


def test_sections_stay_in_their_fences_and_names_in_their_lines(spark):
    rows = rows_of(spark, {"a\nb.md": "````\ncode\n````", "empty.cs": ""})
    doc = pack(rows).document.first().document
    assert "## File: a�b.md\n`````markdown\n````\ncode\n````\n`````\n" in doc and "## File: empty.cs\n````cs\n````\n" in doc


def test_content_filters_limits_and_lines(spark):
    rows = rows_of(spark, {"a.cs": "keep me\n// note\n", "b.cs": "drop me", "c.cs": "x" * 3000})
    got = {r.relative: r for r in pack(rows, include_content=("keep", "xxx"), exclude_content=("drop",), max_file_size="2KB", drop_line_prefixes=("//",)).rows.collect()}
    assert {k: r.status for k, r in got.items()} == {"a.cs": "ok", "b.cs": "content_filtered", "c.cs": "oversize"}
    assert "note" not in got["a.cs"].section
    with pytest.raises(Exception, match="exceeds"):
        pack(rows, max_output="100B").document.collect()
    assert pack(rows, max_files=2).rows.count() == 2


def test_empty_input(spark):
    none = rows_of(spark, {"a.cs": "x"}).limit(0)
    assert pack(none).rows.count() == 0 and pack(none, shard_of=(1, 2)).rows.count() == 0
    assert (t := pack(none).totals().first()).files == 0 and t.bytes == 0 and t.tokens == 0


def fold(entries, shards):
    """The shards by a plain loop."""
    module = lambda p: p.split("/")[0] if "/" in p else "_root"
    groups = {}
    for k, (p, s) in enumerate(entries):
        groups.setdefault(module(p).upper(), []).append((k, p, s))
    target = int(sum(s for _, s in entries) / shards * 1.5)
    loads, out = [0] * shards, {}
    for _, members in sorted(groups.items(), key=lambda g: (-sum(m[2] for m in g[1]), module(g[1][0][1]))):
        whole = len(members) == 1 or sum(m[2] for m in members) <= target
        for unit in [members] if whole else [[m] for m in sorted(members, key=lambda m: (-m[2], m[0]))]:
            at = loads.index(min(loads))
            loads[at] += sum(m[2] for m in unit)
            out |= {m[1]: at + 1 for m in unit}
    return out


def test_shards_against_a_loop(spark):
    rng = random.Random(3)
    sets = [[(f"{rng.choice('ABcd')}{rng.randrange(3)}/f{k}" if rng.random() < 0.8 else f"f{k}", rng.randrange(1000)) for k in range(rng.randrange(1, 40))] for _ in range(4)]
    sets.append([("src/file1.cs", 1000), ("src/file2.cs", 500), ("lib/file3.cs", 800), ("lib/file4.cs", 200), ("test/file5.cs", 300), ("test/file6.cs", 150)])
    for entries in sets:
        rows = spark.createDataFrame([(k, "", "file", p, s) for k, (p, s) in enumerate(entries)], "ord long, repo string, kind string, relative string, size long")
        for n in (1, 3):
            assert {r.relative: r.shard_id for r in shard.assign_shards(rows, n).collect()} == fold(entries, n)


def test_cluster(spark, tmp_path):
    for name in ("beta", "Alpha", "deep/er/repo"):
        write(tmp_path / name, {"x.cs": name, "y.txt": "y"})
        git(tmp_path / name, "init", "-q")
    write(tmp_path / "node_modules" / "r", {"z": "z"})
    git(tmp_path / "node_modules" / "r", "init", "-q")
    assert [r[1] for r in files.find_repos(str(tmp_path), 2)] == ["Alpha", "beta"]
    assert [r[1] for r in files.find_repos(str(tmp_path), 3)] == ["Alpha", "beta", "deep/er/repo"] and files.repo_table(spark, str(tmp_path)).count() == 2
    result = pack_many(files.scan_cluster(spark, str(tmp_path)), extensions=("cs",))
    doc = result.document.first().document
    assert doc.startswith("# Alpha\n\n## File: Alpha/x.cs\n````cs\nAlpha\n````\n\n---\n# beta\n---\n\n## File: beta/x.cs\n")
    assert doc.endswith("```text\nAlpha/x.cs\nbeta/x.cs\n```\n\n") and pack_many(files.scan_cluster(spark, str(tmp_path)), shard_of=(1, 1)).rows.where("kind = 'marker'").count() == 0
    with pytest.raises(TypeError):
        pack_many(files.scan_cluster(spark, str(tmp_path)), nothing=1)


def test_a_failed_repository_is_a_row_or_an_error(spark):
    bad = rows_of(spark, {"a.cs": "x"}, "r").withColumn("error", F.lit("broken"))
    assert "[Error reading file: r/a.cs]\n" in pack_many(bad).document.first().document
    with pytest.raises(PySparkException, match="broken"):
        cluster.with_errors(bad, True).collect()


def test_brain_mode_minifies_and_compresses(spark):
    rows = rows_of(spark, {f"f{k}.cs": "".join(f"// gone\nvar x{i} = ConfigurationValidatorServiceInstance({i * k});\n" for i in range(20)) for k in range(3)})
    doc = pack(rows, brain=True).document.first()
    assert "gone" not in doc.document and doc.tokens_saved > 0


def test_sinks(spark, tmp_path):
    result = pack(rows_of(spark, {"a.cs": "x", "b.cs": "é"}))
    out = str(tmp_path / "deep" / "out.md")
    n = sinks.write_document(result.document, out)
    assert n == os.path.getsize(out) and open(out).read() == result.document.first().document
    sinks.write_document(result.document, out, append=True)
    assert os.path.getsize(out) == 2 * n
    sinks.write_document(result.document, out, direct=True)
    assert os.path.getsize(out) == n and os.listdir(tmp_path / "deep") == ["out.md"]
    sinks.write_parts(result.rows, str(tmp_path / "parts"), render.path_order())
    assert "".join(r.value for r in spark.read.text(str(tmp_path / "parts"), lineSep="\x00").collect()).count("## File") == 2
    sinks.discard(result.document)
    assert [r.display for r in sinks.dry_run(result.rows).collect()] == ["a.cs", "b.cs"] and sinks.count_tokens(result.rows).first().tokens == 2
    with pytest.raises(PySparkException, match="clipboard"):
        sinks.check_clipboard_size(result.document, 3).collect()


def test_documents_in_parts_are_the_same_documents(spark):
    """A module's sections don't meet in one task when it is large: parts, in order, are what one value was."""
    from quillpack.functions.text import module_key
    from quillpack.operators import transforms

    rng = random.Random(5)
    contents = {f"{'aB'[k % 2]}/f{rng.randrange(10**6)}.{'cs md json'.split()[k % 3]}": "x" * rng.randrange(300) + "!!" * (k % 7 == 0) for k in range(60)}
    contents |= {"c/one.py": "y" * 5000, "d/bad.py": "!!", "e/e.py": "".join(f"x = ConfigurationValidatorServiceInstance({k * k});\n" for k in range(30))}
    rows = rows_of(spark, contents)
    rows = rows.union(rows.where("relative LIKE '%7%'")).union(rows.where("relative LIKE 'a%1%'").withColumn("relative", F.lit(None).cast("string")))
    rows = render.with_section(render.with_body(content.with_status(rows, 1 << 20, exclude=["!!"]))).withColumn("module", module_key(F.col("relative")))
    whole = render.document(rows, by=["module"])
    want = {r.module: r.document for r in whole.collect()}
    for most in (900, 1 << 20):
        got = render.document_parts(rows, "module", most=most)
        found = {}
        for r in sorted(got.collect(), key=lambda r: r.part):
            found.setdefault(r.module, []).append(r)
        assert {m: "".join(r.document for r in p) for m, p in found.items()} == want
        assert all([r.part for r in p] == list(range(1, len(p) + 1)) and {r.parts for r in p} == {len(p)} for p in found.values())
        assert (len(found["a"]) > 3) == (most == 900) and max(len(r.document) for r in found["a"]) < (3500 if most == 900 else 1 << 20)
        packed = sorted(transforms.compress_parts(got).collect(), key=lambda r: r.part)
        compressed = {r.module: (r.document, r.tokens_saved) for r in transforms.apply_transforms(whole, [transforms.compress_phrases()]).collect()}
        if most == 900:
            assert "".join(r.document for r in packed if r.module == "a") == transforms.CONTEXT_HEADER + want["a"]
        else:
            assert {r.module: (r.document, r.tokens_saved) for r in packed} == compressed and compressed["e"][1] > 0


def test_no_limit_brings_nothing_to_one_task(spark, sf_dir):
    from quillpack.plans.queries import QUERIES

    plan = QUERIES["brain_pack"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
    rows = rows_of(spark, {f"{k}.cs": "x" for k in range(9)})
    assert filters.first_files(rows, filters.NO_LIMIT).count() == 9 and filters.first_files(rows, 4).count() == 4
