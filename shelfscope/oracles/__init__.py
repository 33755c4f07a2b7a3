"""Check SQL per query, written for DuckDB over the raw tables."""


def all_oracles() -> dict[str, str]:
    from shelfscope.oracles import analysis, pages, store, text

    return {**analysis.ORACLES, **store.ORACLES, **text.ORACLES, **pages.ORACLES}
