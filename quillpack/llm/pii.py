"""PII: information-theoretic sanitisation.

Protected entities (addresses, numbers, secrets) are found by form and replaced. But other words can give them away: the
corpus tells how strongly. With document frequencies over the whole corpus, the pointwise mutual information of a term
and an entity is PMI = log2(n(t, e) N / (n(t) n(e))), and the entity's own information is IC = log2(N / n(e)). A term whose PMI exceeds
`disclosure` of the IC reveals too much: it is generalised to its first letters if those, as a class of words,
reveal less than that, and removed otherwise: in the documents that mention the entity and, once it met it in several texts, in all.

Entities are found, and terms counted over all documents, in one pass, combined in the map tasks. Only documents with entities (and their texts) are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .words import words, words_and_prefixes

#: Kinds of entity and their forms; the first that matches at a place wins.
ENTITIES = {
    "EMAIL": r"(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+",
    "SECRET": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*[\"']?[\w/+=-]{8,}[\"']?)|\bAKIA[0-9A-Z]{16}\b|\b(?:sk|ghp|xoxb)[-_][\w-]{16,}|\b(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,64}\b",
    "IBAN": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "CARD": r"(?<![\w.-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\w-])",
    "SSN": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "PHONE": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![\w-])(?:[0-9]{3}-)?[0-9]{3}-[0-9]{4}(?![\w-])",
    "IP": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w])",
}
_KINDS = list(ENTITIES)
_FORM = re.compile("|".join(f"(?P<{k}>{p})" for k, p in ENTITIES.items()).replace(r"\1", "(?P=gap)").replace("([ -]?)", "(?P<gap>[ -]?)"))
_MAYBE = re.compile(r"[0-9@]")
_WORDS = ("token", "secret", "passw", "api", "akia", "sk-", "sk_", "xoxb", "ghp")
#: Share of an entity's information that a term may give away, and the distinct texts in which the two must meet to be judged: one is enough.
DISCLOSURE, SUPPORT = 0.8, 1
PREFIX = 3
#: Terms in more than this share of the documents are bounded in number (by that of a mean document's terms, divided by it).
FREQUENT = 0.005
#: Distinct texts in which a term must meet an entity to be taken out of texts that don't mention it: one met by chance in one text says nothing of others.
SPREAD = 3
#: Terms (frequent ones, or those to take out everywhere) up to which they are broadcast; beyond, they are joined.
BROADCAST_TERMS = 500_000


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each entity, from left to right."""
    if not _MAYBE.search(text):
        low = text.lower()
        if not any(w in low for w in _WORDS):
            return []
    return [(m.start(), m.end(), next(k for k in _KINDS if m[k] is not None)) for m in _FORM.finditer(text)]


def normal_form(value: str, kind: str) -> str:
    """What two spellings of an entity have in common."""
    low = value.lower()
    return low if kind in ("EMAIL", "SECRET", "IP") else re.sub(r"[^0-9a-z]", "", low)


def blank_entities(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with spaces over its entities, at the same length: their own characters are no terms."""
    out, at = [], 0
    for s, e, _ in found:
        out += [text[at:s], " " * (e - s)]
        at = e
    return "".join([*out, text[at:]])


def sanitise_text(text: str, removed: set[int], general: set[int], found: list[tuple[int, int, str]] | None = None) -> tuple[str, int, int]:
    """text with its entities (found, where they are known) as [KIND], terms in removed as [REMOVED] and those in general as their first letters; and how many of either."""
    found = find_entities(text) if found is None else found
    changes = [(s, e, f"[{k}]") for s, e, k in found]
    terms = 0
    if removed or general:
        starts, ends, hashes = words(blank_entities(text, found))
        for s, e, h in zip(starts.tolist(), ends.tolist(), hashes.view(np.int64).tolist(), strict=True):
            if h in removed or h in general:
                changes.append((s, e, "[REMOVED]" if h in removed else text[s : s + PREFIX] + "…"))
                terms += 1
    out, at = [], 0
    for s, e, new in sorted(changes):
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), len(found), terms


def _terms_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (term, prefix class) hashes of a text."""
    h, p = words_and_prefixes(text, PREFIX)
    h, first = np.unique(h, return_index=True)
    return h.view(np.int64), p[first].view(np.int64)


_SEEN = "term long, n long, doc_id long, text string, starts array<int>, ends array<int>, kinds array<int>, entities array<string>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over (doc_id, text): rows (term, n), in how many of a task's texts each term occurs, and each class of terms (as the
    complement of its hash); and of each text with entities a row with their places, kinds and normal forms.
    """
    held: list[np.ndarray] = []
    size = 0
    numbers, places = pa.int64(), pa.list_(pa.int32())
    kinds_of_column = (numbers, numbers, numbers, pa.string(), places, places, places, pa.list_(pa.string()))
    names = [x.split(" ")[0] for x in _SEEN.split(", ")]

    def flush() -> pa.RecordBatch:
        terms, n = np.unique(np.concatenate([*held, np.zeros(0, dtype=np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64)), *[pa.nulls(len(terms), k) for k in kinds_of_column[2:]]], names=names)

    for batch in batches:
        private: list[tuple] = []
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = find_entities(t := text.as_py() or "")
            terms, classes = _terms_of(blank_entities(t, found) if found else t)
            held += [terms, ~np.unique(classes)]
            size += len(terms)
            if found:
                entities = sorted({f"{k}:{normal_form(t[s:e], k)}" for s, e, k in found})
                private.append((None, None, number, t, [s for s, _, _ in found], [e for _, e, _ in found], [_KINDS.index(k) for _, _, k in found], entities))
        if private:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*private, strict=True), kinds_of_column, strict=True)], names=names)
        if size > 1_000_000:  # a flush of the combiner: counts are summed later all the same
            yield flush()
            held, size = [], 0
    yield flush()


def _near_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (copies, keys, text, starts, ends): a row (key, n_e, copies, term, cls) per key and distinct term of the text, and per class (whose term is its complement)."""
    names = ["key", "n_e", "copies", "term", "cls"]
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        for copies, keys, text, starts, ends in zip(*batch.columns, strict=True):
            terms, classes = _terms_of(blank_entities(text.as_py(), [(s, e, "") for s, e in zip(starts.as_py(), ends.as_py(), strict=True)]))
            own = np.unique(classes)
            terms, classes = np.concatenate([terms, ~own]), np.concatenate([classes, own])
            for k in keys.as_py():
                held.append([np.full(len(terms), x, dtype=np.int64) for x in (k["key"], k["n_e"], copies.as_py())] + [terms, classes])
                size += len(terms)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def revealing_terms(private: DataFrame, counts: DataFrame, n_docs: int, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """th, term, general, texts: the terms that give away an entity of the text th, and in how many distinct texts they meet it.

    private has the texts that mention entities (th, text, starts, ends, entities), counts how many of all n_docs documents have each term or
    class (term, n). Entities that stand in one and the same text only are judged as one, for their counts are equal.
    """
    texts = durable(private.groupBy("th").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("text", "starts", "ends", "entities")]))
    mentions = texts.select("th", "copies", F.explode("entities").alias("entity"))
    stats = mentions.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts")).where((F.col("texts") >= support) & (F.col("n_e") < n_docs))
    keyed = mentions.join(stats, "entity").select("th", F.when(F.col("texts") == 1, F.xxhash64(F.lit("text"), "th")).otherwise(F.xxhash64(F.lit("entity"), "entity")).alias("key"), "n_e").distinct()
    keyed = durable(keyed)
    listed = keyed.groupBy("th").agg(F.collect_list(F.struct("key", "n_e")).alias("keys"))
    near = texts.join(listed, "th").select("copies", "keys", "text", "starts", "ends").mapInArrow(_near_terms, "key long, n_e long, copies long, term long, cls long")
    # A term in as many documents as this can't reveal the entity, even if it stands beside each mention; a class neither.
    bound = F.col("n_e") * F.pow(F.lit(float(n_docs)) / F.col("n_e"), F.lit(1 - disclosure)) * (1 + 1e-9)
    frequent = counts.where(F.col("n") > n_docs * FREQUENT)
    if frequent.count() <= BROADCAST_TERMS:
        beside = near.join(F.broadcast(frequent.select(F.col("term").alias("often"), "n")), (F.col("term") == F.col("often")) & (F.col("n") > bound), "left_anti")
    else:
        beside = near
    beside = beside.join(counts, "term").where(F.col("n") <= bound)
    by_term = durable(beside.groupBy("key", "n_e", "term", "cls", "n").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("texts")))
    ic = F.log2(F.lit(float(n_docs)) / F.col("n_e"))

    def share(both: str):
        return F.log2(F.col(both) * F.lit(float(n_docs)) / (F.col("n").cast("double") * F.col("n_e"))) / ic

    is_class = F.col("term") == F.bitwise_not("cls")
    revealing = by_term.where(~is_class & (F.col("texts") >= support) & (share("n_te") > disclosure))
    strict = by_term.where(is_class & (share("texts") > disclosure)).select("key", "cls", F.lit(False).alias("general"))
    found = revealing.join(strict, ["key", "cls"], "left").select("key", "term", F.coalesce("general", F.lit(True)).alias("general"), "texts")
    return keyed.select("th", "key").join(found, "key").select("th", "term", "general", "texts")


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, spread: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (sanitised), n_entities, n_terms of every row.

    Terms go from the texts that mention an entity they give away and, with spread, from all texts if they meet it in so many distinct
    ones; without spread, texts without entities come back as they are. Defined cases: a NULL text stays NULL and an empty one empty, with no entities; NULL ids are carried; a repeated
    row counts as often as it occurs in frequencies, once as support; an entity that every document mentions has no
    information to protect and reveals no terms; very long texts are searched whole, and entities in them have any length; other columns are
    ignored, whatever their names; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @F.pandas_udf("boolean")
    def mentions_any(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and bool(find_entities(t)) for t in texts], dtype="bool")

    @F.pandas_udf("array<long>")
    def terms_in(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(words(blank_entities(t, find_entities(t)))[2]).view(np.int64) if t else [] for t in texts], dtype="object")

    seen = durable(rows.mapInArrow(_scan, _SEEN))
    private = seen.where("term IS NULL").select("doc_id", F.xxhash64("text").alias("th"), "text", "starts", "ends", "kinds", "entities")
    counts = durable(seen.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")))
    reveal = revealing_terms(private, counts, rows.count(), disclosure, support)
    own = reveal.select("th", "term", "general")
    wide = None
    if spread is not None:
        everywhere = durable(reveal.where(F.col("texts") >= spread).groupBy("term").agg(F.min("general").alias("general")))
        if everywhere.count() <= BROADCAST_TERMS:
            listed = everywhere.orderBy("term").toArrow()
            wide = docs.sparkSession.sparkContext.broadcast((listed["term"].to_numpy(), listed["general"].to_numpy()))
        else:
            held = rows.select(F.xxhash64("text").alias("th"), F.explode(terms_in("text")).alias("term"))
            own = own.union(held.join(everywhere, "term").select("th", "term", "general"))

    def cleaned_up(texts: pd.Series, removed: pd.Series, general: pd.Series, spans) -> pd.DataFrame:
        terms, mild = wide.value if wide is not None else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
        out = []
        for t, r, g, found in zip(texts, removed, general, spans, strict=True):
            gone, cut = set(() if r is None else r), set(() if g is None else g)
            if t and len(terms):
                h = words(blank_entities(t, found) if found else t)[2].view(np.int64)
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = at[terms[at] == h]
                gone |= set(terms[hit[~mild[hit]]].tolist())
                cut |= set(terms[hit[mild[hit]]].tolist())
            out.append(sanitise_text(t, gone, cut, found) if found or (t and (gone or cut)) else (t, 0, 0))
        return pd.DataFrame(out, columns=["text", "n_entities", "n_terms"])

    @F.pandas_udf("text string, n_entities long, n_terms long")
    def clean(texts: pd.Series, removed: pd.Series, general: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return cleaned_up(texts, removed, general, [[(int(s), int(e), _KINDS[k]) for s, e, k in zip(*x, strict=True)] for x in zip(starts, ends, kinds, strict=True)])

    @F.pandas_udf("text string, n_entities long, n_terms long")
    def clean_other(texts: pd.Series, removed: pd.Series, general: pd.Series) -> pd.DataFrame:
        return cleaned_up(texts, removed, general, [[]] * len(texts))

    # Per text, a term that any of its entities forbids outright is removed.
    by_term = own.groupBy("th", "term").agg(F.min("general").alias("general"))
    lists = by_term.groupBy("th").agg(F.collect_list(F.when(~F.col("general"), F.col("term"))).alias("removed"), F.collect_list(F.when(F.col("general"), F.col("term"))).alias("general"))
    none = F.lit(None).cast("array<long>")
    others = rows.where(~mentions_any("text"))
    if spread is None or (wide is not None and not len(wide.value[0])):
        untouched = others.select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_terms"))
    else:
        if wide is None:
            others = others.withColumn("th", F.xxhash64("text")).join(lists, "th", "left")
        else:
            others = others.withColumn("removed", none).withColumn("general", none)
        untouched = others.select("doc_id", clean_other("text", "removed", "general").alias("x")).select("doc_id", "x.text", "x.n_entities", "x.n_terms")
    cleaned = private.join(lists, "th", "left").select("doc_id", clean("text", "removed", "general", "starts", "ends", "kinds").alias("x")).select("doc_id", "x.text", "x.n_entities", "x.n_terms")
    return cleaned.unionByName(untouched)
