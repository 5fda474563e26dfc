"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from millrace.functions.text import NARROW, WIDE

_WIDE, _NARROW = WIDE, NARROW.replace("'", "''")


def narrow(x: str) -> str:
    return f"translate({x}, '{_WIDE}', '{_NARROW}')"


def grams(t: str, low: int = 2, high: int = 4) -> str:
    return f"(case when length({t}) >= {low} then flatten(list_transform(range({low}, least({high}, length({t})) + 1), lambda n: list_transform(range(1, length({t}) - n + 2), lambda i: substring({t}, i, n)))) when length({t}) > 0 then [{t}] else [] end)"


def tokens(x: str) -> str:
    terms = f"regexp_extract_all(lower({narrow(f'coalesce({x}, chr(32))')}), '([a-z0-9_.%-]+|[一-鿿]+)', 1)"
    return f"flatten(list_transform({terms}, lambda t: case when regexp_matches(t, '^[一-鿿]') then {grams('t')} else [t] end))"


CHUNKS = "select distinct chunk_id, doc_id, page, section, clause_id, text, coalesce(section, '') || ' ' || text as body from chunks"
QUESTION_TEXT = "concat_ws(' ', question, array_to_string(list_transform(list_sort(map_entries(options)), lambda e: e.key || ' ' || e.value), ' '))"


def bm25(source: str, queries: str, body: str, key: str = "chunk_id", most: int | None = 160, times: str = "1") -> str:
    """Common table expressions that end in sc(qid, key, score); source and queries are SQL with body, and qid and text. A query keeps
    its ``most`` rarest terms, all of them without."""
    kept = "select qid, term, times, idf from q join w using (term)"
    if most is not None:
        kept = f"select * from (select qid, term, times, idf, row_number() over (partition by qid order by idf desc, term) as r from q join w using (term)) where r <= {most}"
    return f"""
    c as materialized (select {key}, {tokens(body)} as toks from ({source})),
    s as (select count(*)::double as n, avg(len(toks)) as ml from c),
    q as materialized (select qid, term, count(*) as times from (select qid, unnest({tokens('text')}) as term from ({queries})) group by all),
    tf as materialized (select {key}, l, term, count(*) as tf from (select {key}, len(toks) as l, unnest(toks) as term from c) where term in (select term from q) group by all),
    w as materialized (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from (select term, count(*)::double as df from tf group by term), s),
    kept as ({kept}),
    sc as materialized (select qid, {key}, sum({times} * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / ml))) as score from kept join tf using (term), s group by all)"""
