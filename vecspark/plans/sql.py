"""SQL of the queries' results, for DuckDB, put together from common table expressions."""

from __future__ import annotations

QUERIES = "q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0)"


def _fold(terms: str, n: str) -> str:
    return f"list_reduce(list_transform(range(1, {n} + 1), lambda i: {terms}), lambda s, x: s + x, 0.0::double)"


def dot(a: str, b: str) -> str:
    return _fold(f"{a}[i]::double * {b}[i]::double", f"len({a})")


def ip(a: str, b: str) -> str:
    return f"(1.0::double - {dot(a, b)})"


def l2(a: str, b: str) -> str:
    return _fold(f"({a}[i]::double - {b}[i]::double) * ({a}[i]::double - {b}[i]::double)", f"len({a})")


def normalized(base: str, name: str) -> list[str]:
    """``name``: the vectors of ``base`` over their lengths."""
    return [
        f"{name}_l as (select vec_id, embedding, sqrt({dot('embedding', 'embedding')}) + 1e-30::double as len from {base})",
        f"{name} as (select vec_id, list_transform(embedding, lambda x: x::double / len) as embedding from {name}_l)",
    ]


def select(ctes: list[str], final: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + final


def top(source: str, k: int, name: str = "top") -> str:
    """The k closest rows of each query in ``source`` (query_id, vec_id, dist)."""
    return f"{name} as (select *, row_number() over (partition by query_id order by dist, vec_id) as rank from {source} qualify rank <= {k})"


def rounded(value: str) -> str:
    """Six decimals, and no negative zero."""
    return f"case when round({value}, 6) = 0 then 0.0::double else round({value}, 6) end"


def out(source: str = "top") -> str:
    return f"select query_id, rank, vec_id, {rounded('dist')} as dist from {source}"


def pairs(distance: str = "", where: str = "true", base: str = "embeddings", name: str = "d") -> str:
    distance = distance or ip("q.q", "e.embedding")
    return f"{name} as (select q.query_id, e.vec_id, {distance} as dist from q, {base} e where {where})"


def kmeans(k: int, rounds: int, base: str = "embeddings", vector: str = "embedding", p: str = "") -> list[str]:
    """Centroids ``{p}c{rounds}`` after some rounds from the k first vectors, and the assignment ``{p}a`` to them."""
    ctes = [f"{p}c0 as (select (row_number() over (order by vec_id) - 1)::int as cid, list_transform({vector}, lambda x: x::double) as c from {base} qualify cid < {k})"]
    for r in range(rounds + 1):
        a = f"{p}a{r}" if r < rounds else f"{p}a"
        ctes.append(f"{a} as (select e.*, c.cid, {l2(f'e.{vector}', 'c.c')} as cdist from {base} e, {p}c{r} c qualify row_number() over (partition by e.vec_id order by cdist, c.cid) = 1)")
        if r < rounds:
            ctes.append(
                f"{p}s{r} as (select cid, i, sum(round({vector}[i]::double * 1e9::double)::bigint)::double / count(*)::double / 1e9::double as v from {a}, unnest(range(1, len({vector}) + 1)) t(i) group by cid, i),\n"
                f"{p}n{r} as (select cid, list(v order by i) as c from {p}s{r} group by cid),\n"
                f"{p}c{r + 1} as (select o.cid, coalesce(n.c, o.c) as c from {p}c{r} o left join {p}n{r} n using (cid))"
            )
    return ctes


def probes(centroids: str, nprobe: int, q: str = "q", vector: str = "q") -> str:
    return f"probes as (select q.query_id, c.cid, {l2(f'q.{vector}', 'c.c')} as dist, row_number() over (partition by q.query_id order by dist, c.cid) as rank from {q} q, {centroids} c qualify rank <= {nprobe})"


def pq(m: int, ks: int, rounds: int, base: str = "embeddings", vector: str = "embedding", p: str = "p") -> list[str]:
    """Codebook ``{p}b{rounds}`` (m, k, cw) and codes ``{p}codes`` (vec_id, code)."""
    sub = f"list_transform({vector}[m * size + 1 : (m + 1) * size], lambda x: x::double)"
    ctes = [
        f"{p}v as (select vec_id, m::int as m, {sub} as s from (select *, len({vector}) // {m} as size from {base}), unnest(range({m})) t(m))",
        f"{p}b0 as (select m, (row_number() over (partition by m order by vec_id) - 1)::int as k, s as cw from {p}v qualify k < {ks})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"{p}a{r} as (select v.vec_id, v.m, v.s, b.k, {l2('v.s', 'b.cw')} as d from {p}v v join {p}b{r} b using (m) qualify row_number() over (partition by v.vec_id, v.m order by d, b.k) = 1)")
        if r < rounds:
            ctes.append(
                f"{p}s{r} as (select m, k, i, sum(round(s[i] * 1e9::double)::bigint)::double / count(*)::double / 1e9::double as v from {p}a{r}, unnest(range(1, len(s) + 1)) t(i) group by m, k, i),\n"
                f"{p}n{r} as (select m, k, list(v order by i) as cw from {p}s{r} group by m, k),\n"
                f"{p}b{r + 1} as (select o.m, o.k, coalesce(n.cw, o.cw) as cw from {p}b{r} o left join {p}n{r} n using (m, k))"
            )
    ctes.append(f"{p}codes as (select vec_id, list(k order by m) as code from {p}a{rounds} group by vec_id)")
    return ctes


def lut(book: str, q: str = "q", vector: str = "q", term=dot, keys: str = "query_id") -> str:
    """``lut``: for each query a list by m of lists by k."""
    return (
        f"lut0 as (select {', '.join('q.' + k for k in keys.split(', '))}, b.m, b.k, {term(f'q.{vector}[b.m * len(b.cw) + 1 : (b.m + 1) * len(b.cw)]', 'b.cw')} as v from {q} q, {book} b),\n"
        f"lut as (select {keys}, list(vs order by m) as lut from (select {keys}, m, list(v order by k) as vs from lut0 group by {keys}, m) group by {keys})"
    )


def looked_up(lut: str, code: str) -> str:
    return f"list_reduce(list_transform(range(1, len({code}) + 1), lambda i: {lut}[i][{code}[i] + 1]), lambda s, x: s + x, 0.0::double)"
