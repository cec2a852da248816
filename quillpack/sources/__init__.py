"""Where file rows come from: folders, git repositories, tables, settings and history."""
