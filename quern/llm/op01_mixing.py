"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that hold them. A network
carries tokens from patterns to the sources that may use them, up to each source's quota; a
pattern's first pass is free and each repetition dearer than the one before, so that text is
repeated only where quotas can't be met otherwise. Inside a pattern documents are taken in a
seeded order: by the leading bits of a hash the pattern falls into buckets, whose sums say which
buckets lie wholly in one source's share. Only the few buckets across which a share ends are
looked into, document by document.

What reaches the driver: one row a pattern, however many there are, and one row a share's end.
Nothing of a document's size or number is collected.

A null size counts as 0; a document of size 0 is never taken. A null source is a source of its
own. A document without sources is never taken. Rows with the same id and pattern are taken or
left together. A very long text counts whole. Equal shares and equal hashes go by id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import materialise, unused

#: Buckets hold about ROWS documents, and a pattern has at most 2**BITS: beyond a thousand million documents buckets grow, by sums of fixed size.
ROWS, BITS = 1024, 20
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def min_cost_flow(n: int, arcs: Sequence[tuple[int, int, int, float]], s: int, t: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a cheapest largest flow. Costs mustn't be negative. Shortest paths with potentials; those of one cost are filled together, by blocking flows."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to += [v, u]
        cap += [c, 0]
        cost += [w, -w]
    lift = [0.0] * n
    while True:
        far, by = [float("inf")] * n, [-1] * n
        far[s] = 0.0
        heap = [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if cap[e] > 0 and (x := d + cost[e] + lift[u] - lift[to[e]]) < far[to[e]] - 1e-12:
                    far[to[e]], by[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if by[t] < 0:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        lift = [p + (d if d < float("inf") else far[t]) for p, d in zip(lift, far)]
        while True:
            level, queue = [-1] * n, [s]
            level[s] = 0
            for u in queue:
                for e in out[u]:
                    if cap[e] > 0 and level[to[e]] < 0 and abs(cost[e] + lift[u] - lift[to[e]]) < 1e-9:
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if level[t] < 0:
                break
            at, path, u = [0] * n, [], s
            while True:
                if u == t:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    path, u = [], s
                while at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if cap[e] > 0 and level[to[e]] == level[u] + 1 and abs(cost[e] + lift[u] - lift[to[e]]) < 1e-9:
                        break
                    at[u] += 1
                if at[u] < len(out[u]):
                    path.append(e)
                    u = to[e]
                elif u == s:
                    break
                else:
                    u = to[path.pop() ^ 1]
                    at[u] += 1


def capped_shares(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """All sizes' sum shared by weight, no share above ``cap`` times its size; the excess is shared again by weight among the rest."""
    total, share = float(sum(sizes)), [0.0] * len(sizes)
    capped: set[int] = set()
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        share = [cap * sizes[i] if i in capped else rest * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and share[i] > cap * sizes[i]}
        if not over:
            return share
        capped |= over


def route(patterns: Sequence[tuple[tuple, int]], quotas: dict, repeat_costs: Sequence[float]) -> list[dict]:
    """For each pattern (sources, tokens) the tokens each source takes from it. One entry of ``repeat_costs`` a pass, not falling."""
    sources = list(quotas)
    at = {x: 1 + len(patterns) + i for i, x in enumerate(sources)}
    t = 1 + len(patterns) + len(sources)
    arcs = [(0, 1 + i, tokens, c) for i, (_, tokens) in enumerate(patterns) for c in repeat_costs]
    inner = [(1 + i, at[x], len(repeat_costs) * tokens, 0.0) for i, (held, tokens) in enumerate(patterns) for x in held]
    ends = [(at[x], t, int(round(quotas[x])), 0.0) for x in sources]
    flow = min_cost_flow(t + 1, arcs + inner + ends, 0, t)[len(arcs) :]
    out, k = [], 0
    for held, _ in patterns:
        out.append({x: flow[k + i] for i, x in enumerate(held) if flow[k + i]})
        k += len(held)
    return out


def _fill(rows: list[tuple], parts: list[tuple]) -> dict:
    """Which source takes which row: ``parts`` (source, room, whether it is one: else rows left over)
    in turn take what fits of the rows left; at the end of what is taken, the row that comes nearest."""
    got, left = {}, list(range(len(rows)))
    wanted = [(x, room) for x, room, taken in parts if taken]
    spare = any(not taken and room > 0 for _, room, taken in parts)
    for at, (x, room) in enumerate(wanted):
        rest = []
        for i in left:
            if rows[i][1] <= room:
                got[i] = x
                room -= rows[i][1]
            else:
                rest.append(i)
        left = rest
        if at == len(wanted) - 1 and left and not spare:
            got |= dict.fromkeys(left, x)
        elif at == len(wanted) - 1 and left and room > 0:
            i = min(left, key=lambda i: (abs(rows[i][1] - room), i))
            if abs(rows[i][1] - room) < room:
                got[i] = x
    return got


def mix(sized: DataFrame, quotas, repeat_costs: Sequence[float] = (0.0, 1.0, 3.0), seed: int = 17, id_col: str = "doc_id") -> tuple[DataFrame, dict]:
    """Mix ``sized`` (id, size long, sources array<string>), a table that reads the same each time.

    ``quotas`` maps each source to the tokens it should get, or makes that map from the dict of
    the sources' sizes. Returns the rows (id, size, sources, copies int, picks: one source a
    copy) and the quotas.
    """
    spark = sized.sparkSession
    base = sized.select(F.col(id_col).alias("_id"), F.coalesce("size", F.lit(0)).alias("_size"), F.coalesce(F.array_sort(F.array_distinct("sources")), F.array().cast("array<string>")).alias("_held"))
    found = base.groupBy("_held").agg(F.sum("_size").alias("tokens"), F.count("*").alias("n")).collect()
    found = sorted(found, key=lambda r: [(x is None, x or "") for x in r._held])
    sizes: dict = {}
    for r in found:
        for x in r._held:
            sizes[x] = sizes.get(x, 0) + r.tokens
    quotas = quotas(sizes) if callable(quotas) else quotas
    flows = route([(tuple(r._held), r.tokens) for r in found], quotas, repeat_costs)

    # Each pass over a pattern is an axis of its tokens; shares are laid on it one after another.
    parts, marks, bits = [], [], []
    for k, (r, flow) in enumerate(zip(found, flows)):
        bits.append(min(BITS, max(1, (r.n // ROWS).bit_length())))
        at, shares = 0, []
        for x in sorted(flow, key=lambda x: (x is None, x or "")):
            room = flow[x]
            while room:
                here = min(room, r.tokens - at % r.tokens)
                shares.append((at // r.tokens, at % r.tokens, at % r.tokens + here, x))
                at, room = at + here, room - here
        parts.append(shares)
        marks += [(k, p) for p in sorted({b for _, lo, hi, _ in shares for b in (lo, hi)} - {0, r.tokens})]

    pattern = spark.createDataFrame([(k, list(r._held), bits[k]) for k, r in enumerate(found)], "_k int, _held array<string>, _bits int")
    docs = base.join(F.broadcast(pattern), "_held").withColumn("_hash", F.xxhash64(F.lit(seed), "_id")).withColumn("_bucket", F.expr("shiftrightunsigned(_hash, 64 - _bits)")) if found else base.withColumns({"_k": F.lit(0), "_bits": F.lit(1), "_hash": F.lit(0).cast("long"), "_bucket": F.lit(0).cast("long")})
    edges: dict[int, dict[int, tuple[int, int]]] = {}
    if marks:
        sums = docs.groupBy("_k", "_bucket").agg(F.sum("_size").alias("s"))
        upto = sums.withColumn("hi", F.expr("sum(s) over (partition by _k order by _bucket)")).withColumn("lo", F.expr("hi - s"))
        where = upto.join(F.broadcast(spark.createDataFrame(marks, "_k int, p long")), "_k").where("lo < p and p <= hi").select("_k", "_bucket", "lo", "hi").distinct()
        for r in where.collect():
            edges.setdefault(r._k, {})[r._bucket] = (r.lo, r.hi)

    runs, fills = [], {}
    for k, shares in enumerate(parts):
        own = sorted(edges.get(k, {}).items())
        for b, (lo, hi) in own:
            by_pass: dict[int, list] = {}
            for j, a, z, x in shares:
                if min(z, hi) > max(a, lo):
                    by_pass.setdefault(j, []).append((x, min(z, hi) - max(a, lo), True))
            for v in by_pass.values():
                if (rest := hi - lo - sum(room for _, room, _ in v)) > 0:
                    v.append((None, rest, False))
            fills[(k, b)] = by_pass
        # Between edge buckets a pass belongs to one source, or to none.
        spans, first, lo = [], 0, 0
        for b, (a, z) in [*own, (1 << bits[k], (found[k].tokens, 0))]:
            if b > first:
                spans.append((first, b - 1, lo, a))
            first, lo = b + 1, z
        table = [(p, q, x) for p, q, a, z in spans for j, l, h, x in shares if l <= a and z <= h and z > a]
        runs.append((k, table, [b for b, _ in own]))
    plan = spark.createDataFrame(runs or [(0, [], [])], "_k int, _runs array<struct<p:long,q:long,x:string>>, _edges array<long>")
    marked = docs.join(F.broadcast(plan), "_k").withColumn("_at_edge", F.array_contains("_edges", F.col("_bucket")))
    inside = marked.where("not _at_edge").select("_id", "_size", "_held", F.expr("if(_size > 0, transform(filter(_runs, r -> r.p <= _bucket and _bucket <= r.q), r -> r.x), array())").alias("picks"))
    result = inside
    if fills:

        def fill(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_hash", "_id", "_size"], kind="stable").reset_index(drop=True)
            rows = list(zip(pdf["_id"], (pdf["_size"] * pdf["_n"]).astype(int)))
            live = [i for i, (_, n) in enumerate(rows) if n > 0]
            picks = [[] for _ in rows]
            for _, v in sorted(fills[(int(key[0]), int(key[1]))].items()):
                for i, x in _fill([rows[j] for j in live], v).items():
                    picks[live[i]].append(x)
            return pd.DataFrame({"_k": pdf["_k"], "_id": pdf["_id"], "_size": pdf["_size"], "picks": picks})

        id_type = base.schema["_id"].dataType.simpleString()
        edge = marked.where("_at_edge").select("_k", "_bucket", "_hash", "_id", "_size", "_held")
        chosen = edge.groupBy("_k", "_bucket", "_hash", "_id", "_size").agg(F.count("*").alias("_n")).groupBy("_k", "_bucket").applyInPandas(fill, f"_k int, _id {id_type}, _size long, picks array<string>")
        back = edge.alias("e").join(chosen.alias("c"), F.expr("e._k = c._k and e._id <=> c._id and e._size = c._size")).select("e._id", "e._size", "e._held", "c.picks")
        result = inside.unionByName(back)
    return result.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_held").alias("sources"), F.size("picks").alias("copies"), "picks"), quotas


def mix_by_rank(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Mix documents of one source each; ``weights`` repeat along the sources by code point, null last, and targets are capped at ``cap`` times a source's size.

    Returns the id, size (words), source_size, target, taken (words, repeats counted), copies and source.
    """
    sized = materialise(docs.select(F.col(id_col).alias("_doc"), word_count(text_col).alias("size"), F.array(F.col(source_col).cast("string")).alias("sources")), "sized")
    sizes: dict = {}

    def quotas(found: dict) -> dict:
        sizes.update(found)
        order = sorted(found, key=lambda x: (x is None, x or ""))
        return dict(zip(order, capped_shares([found[x] for x in order], [weights[i % len(weights)] for i in range(len(order))], cap)))

    # Repetition is dearer each time; a source may be read int(cap) times.
    rows, targets = mix(sized, quotas, [i * (i + 1) / 2 for i in range(int(cap))], seed, "_doc")
    spark = docs.sparkSession
    per_source = spark.createDataFrame([(x, sizes[x], float(targets[x])) for x in sizes], "_source string, source_size long, target double")
    joined = rows.join(F.broadcast(per_source), F.expr("sources[0] <=> _source"))
    return joined.select(F.col("_doc").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", F.col("_source").alias("source_name"))


def take_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_by_rank`` takes it, with all its columns, whatever their names.

    Rows of equal id, text and source are taken or left together; a null id, text or source differs from an empty one.
    """
    key, taken_key, copies, copy = unused(docs, 4)
    at = lambda c: F.col(f"`{c}`")
    named = F.to_json(F.struct(at(id_col).alias("i"), F.xxhash64(at(text_col)).alias("t"), F.length(at(text_col)).alias("n"), at(source_col).alias("s")))
    keyed = docs.withColumn(key, named)
    taken = mix_by_rank(keyed, weights, cap, seed, key, text_col, source_col).where("copies > 0").select(F.col(key).alias(taken_key), F.col("copies").alias(copies)).dropDuplicates([taken_key])
    return keyed.join(taken, F.col(key) == F.col(taken_key)).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[at(c) for c in docs.columns])
