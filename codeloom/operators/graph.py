"""Graph operators: PageRank, reverse reachability, entry paths, import cycles, orphans.

Graphs are keyed by ``root``, one per repository. PageRank and cycles run one repository per group, in parallel over
repositories; a single graph too large for one worker has the distributed forms ``pagerank_distributed`` and
``cycles_distributed``, which write every round's table. ``ranked`` and ``import_cycles`` choose by size. Reachability is a loop of at most six joins either way.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.checkpoints import kept, small_or_merged
from codeloom.functions import scalars as X


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = S.DAMPING, tolerance: float = S.TOLERANCE, rounds: int = S.MAX_ROUNDS) -> DataFrame:
    """``root, path, rank``. nodes: ``root, path, weight`` (teleport weights); edges: ``root, src, dst``, distinct.

    The rank of nodes without outgoing edges returns to the teleport shares. One node alone has rank 1.
    """
    import numpy as np

    both = nodes.select("root", "path", F.col("weight").cast("double").alias("weight"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select("root", F.col("src").alias("path"), F.lit(None).cast("double").alias("weight"), "dst"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["dst"].isna()].sort_values("path")
        paths = own["path"].to_numpy()
        at = {p: i for i, p in enumerate(paths)}
        links = group[group["dst"].notna()]
        links = links[links["path"].isin(at) & links["dst"].isin(at)]
        src, dst = links["path"].map(at).to_numpy(dtype=np.int64), links["dst"].map(at).to_numpy(dtype=np.int64)
        n = len(paths)
        weight = own["weight"].fillna(0.0).to_numpy()
        share = weight / weight.sum() if weight.sum() > 0 else np.full(n, 1.0 / max(1, n))
        out = np.bincount(src, minlength=n).astype(float)
        rank = share.copy() if n != 1 else np.ones(1)
        for _ in range(rounds if n > 1 else 0):
            flow = np.bincount(dst, weights=rank[src] / out[src], minlength=n)
            new = (1 - damping) * share + damping * (flow + rank[out == 0].sum() * share)
            moved = np.abs(new - rank).sum()
            rank = new
            if moved < tolerance:
                break
        return pd.DataFrame({"root": group["root"].iloc[0], "path": paths, "rank": rank})

    return both.groupBy("root").applyInPandas(run, "root string, path string, rank double")


def pagerank_distributed(nodes: DataFrame, edges: DataFrame, *, damping: float = S.DAMPING, tolerance: float = S.TOLERANCE, rounds: int = S.MAX_ROUNDS) -> DataFrame:
    """The same ranks for graphs too large for one worker: joins and sums, cut every round."""
    total = nodes.groupBy("root").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    share = F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(1.0 / F.col("n"))
    base = kept(nodes.join(total, "root").select("root", "path", share.alias("share")))
    ends = base.select("root", "path")
    links = edges.join(ends.withColumnRenamed("path", "src"), ["root", "src"]).join(ends.withColumnRenamed("path", "dst"), ["root", "dst"])
    out = links.groupBy("root", "src").agg(F.count("*").alias("out"))
    links = kept(links.join(out, ["root", "src"]).select("root", F.col("src").alias("path"), "dst", "out"))
    sources = links.select("root", "path").distinct()
    ranks = base.select("root", "path", F.col("share").alias("rank"))
    before: tuple[DataFrame, ...] = ()
    for _ in range(rounds):
        flow = links.join(ranks, ["root", "path"]).groupBy("root", F.col("dst").alias("path")).agg(F.sum(F.col("rank") / F.col("out")).alias("flow"))
        loose = ranks.join(sources, ["root", "path"], "left_anti").groupBy("root").agg(F.sum("rank").alias("loose"))
        new = base.join(flow, ["root", "path"], "left").join(loose, "root", "left").join(ranks, ["root", "path"])
        rank = (1 - damping) * F.col("share") + damping * (F.coalesce("flow", F.lit(0.0)) + F.coalesce("loose", F.lit(0.0)) * F.col("share"))
        step = kept(new.select("root", "path", rank.alias("new"), "rank"), *before)
        before = (step,)
        ranks = step.select("root", "path", F.col("new").alias("rank"))
        if (step.groupBy("root").agg(F.sum(F.abs(F.col("new") - F.col("rank"))).alias("moved")).agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    return ranks


def direct_callers(edges: DataFrame, changed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Who calls a changed symbol, each with its strongest relation (the first one on ties).

    changed: ``id, ord`` (long), and the columns of by where it holds many changes. Result: those columns and
    ``id, depth, strength, via_target, via_file, via_line``.
    """
    hits = edges.where("source_id is not null").join(changed.select(*by, F.col("id").alias("target_id"), "ord"), "target_id")
    best = F.max_by(F.struct("target_id", "call_file", "call_line", "strength"), F.struct("strength", -F.col("ord"), -F.col("seq")))
    return hits.groupBy(*by, F.col("source_id").alias("id")).agg(best.alias("b")).select(*by, "id", F.lit(1).alias("depth"), "b.strength", F.col("b.target_id").alias("via_target"), F.col("b.call_file").alias("via_file"), F.col("b.call_line").alias("via_line"))


def impact(edges: DataFrame, changed: DataFrame, max_depth: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Everything that reaches a changed symbol within max_depth calls, at its least depth.

    A node's strength is the strongest over its shortest paths of the weakest relation on the path. The changed symbols
    aren't part of the result. Columns as in ``direct_callers``; depth 1 is included. With by, each change is followed on
    its own, all of them in the same joins. Edges are written once as they are; a step pairs up only those that lead to the
    symbols reached before it.
    """
    calls = kept(edges.where("source_id is not null").select("source_id", "target_id", "seq", "call_file", "call_line", "strength"))
    key = [*by, "source_id"]
    front = changed.select(*by, "id", F.lit(3).alias("strength"), F.col("ord").cast("long").alias("rank"))
    seen = changed.select(*by, F.col("id").alias("source_id"))
    out = None
    for depth in range(1, max_depth + 1):
        ends = kept(front.select(F.col("id").alias("target_id")).distinct())
        pairs = kept(_pairs(calls.join(small_or_merged(ends), "target_id", "left_semi")), ends)
        links = pairs.select("source_id", "target_id", *[F.col(f"s{k}").isNotNull().alias(f"h{k}") for k in _STRENGTHS])
        step = links.join(front, F.col("target_id") == F.col("id")).groupBy(*key).agg(*[_reached(k) for k in _STRENGTHS])
        step = kept(step.join(seen, key, "left_anti").select(*key, *_best()))
        via = front.withColumnRenamed("id", "target_id")
        found = step.join(via, [*by, "rank"]).join(pairs, ["source_id", "target_id"])
        hop = _first_call(lambda c: F.least(c["edge"], F.col("strength")) == F.col("now")).alias("hop")
        found = found.select(*key, "now", "before", "target_id", hop)
        order = []
        if depth < max_depth:  # what comes first of the paths to a symbol orders it, whatever its strength
            first = step.select(*key, "before").join(via.withColumnRenamed("rank", "before"), [*by, "before"]).join(pairs, ["source_id", "target_id"])
            order = [*by, "before", "seq"]
            found = found.join(first.select(*key, _first_call(lambda c: F.lit(True))["seq"].alias("seq")), key).repartitionByRange(*order).sortWithinPartitions(*order)
        rank = F.monotonically_increasing_id() if order else F.lit(None).cast("long")
        found = kept(found.select(*by, F.col("source_id").alias("id"), F.lit(depth).alias("depth"), F.col("now").alias("strength"), rank.alias("rank"), F.col("target_id").alias("via_target"), F.col("hop.call_file").alias("via_file"), F.col("hop.call_line").alias("via_line")))
        out = found if out is None else out.unionByName(found)
        seen = seen.unionByName(found.select(*by, F.col("id").alias("source_id")))
        front = found.select(*by, "id", "strength", "rank")
        if found.isEmpty():
            break
    return out.drop("rank")


def reach(links: DataFrame, changed: DataFrame, max_depth: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """``id, depth, strength`` and the columns of by: as ``impact``, without the calls on the way.

    links: ``source_id, target_id, strength``, one row a pair, its strongest. Without calls on the way nothing has to be put
    in order: a step joins numbers or ids with strengths, and only what it reaches anew is written.
    """
    links = kept(links.withColumnRenamed("strength", "edge"))
    key = [*by, "id"]
    front = kept(changed.select(*key, F.lit(3).alias("strength")).distinct())
    seen, out = front.select(*key), None
    for depth in range(1, max_depth + 1):
        near, ends = links, kept(front.select(F.col("id").alias("target_id")).distinct())
        if ends.count() <= _FEW_ENDS:
            near = links.join(F.broadcast(ends), "target_id", "left_semi")
        step = near.join(small_or_merged(front.withColumnRenamed("id", "target_id")), "target_id").select(*by, F.col("source_id").alias("id"), F.least("edge", "strength").alias("strength"))
        # What was seen before is told in the same grouping: an anti join would be moved below it, to every path.
        step = step.unionByName(seen.withColumn("strength", F.lit(_SEEN))).groupBy(*key).agg(F.max("strength").alias("strength"))
        front = kept(step.where(F.col("strength") < _SEEN), ends)
        found = front.select(*by, "id", F.lit(depth).alias("depth"), "strength")
        out = found if out is None else out.unionByName(found)
        seen = seen.unionByName(front.select(*key))
        if front.isEmpty():
            break
    return out


_FEW_ENDS = 500_000
_SEEN = 9  # above all strengths
_STRENGTHS = (1, 2, 3)


def _pairs(edges: DataFrame) -> DataFrame:
    """``source_id, target_id``, and the first call of each strength between the two, as s1, s2 and s3."""
    call = F.struct("seq", "call_file", "call_line", F.col("strength").alias("edge"))
    return edges.where("source_id is not null").groupBy("source_id", "target_id").agg(*[F.min(F.when(F.col("strength") == k, call)).alias(f"s{k}") for k in _STRENGTHS])


def _first_call(usable) -> Column:
    """The first call of a pair that is usable."""
    return F.array_min(F.filter(F.array(*[F.col(f"s{k}") for k in _STRENGTHS]), lambda c: c.isNotNull() & usable(c)))


def _reached(k: int) -> Column:
    """The least rank of the symbols through which a path of strength k comes."""
    weaker = (F.col("strength") > k) & F.col(f"h{k}")
    same = (F.col("strength") == k) & F.array_contains(F.array(*[F.col(f"h{j}") for j in _STRENGTHS if j >= k]), True)
    return F.min(F.when(weaker | same, F.col("rank"))).alias(f"r{k}")


def _best() -> list[Column]:
    """The strongest path's strength and rank, and the least rank of any."""
    ranks = [F.col(f"r{k}") for k in reversed(_STRENGTHS)]
    return [F.coalesce(*[F.when(F.col(f"r{k}").isNotNull(), F.lit(k)) for k in reversed(_STRENGTHS)]).alias("now"), F.coalesce(*ranks).alias("rank"), F.least(*ranks).alias("before")]


def focus_ancestors(rows: DataFrame, symbols: DataFrame, focus_files: list[str], max_depth: int = 6) -> DataFrame:
    """``id``: impact rows in the focus files and the hops between them and the change."""
    mine = rows.where("depth >= 2").join(symbols.where(F.col("file").isin(focus_files)).select("id"), "id", "left_semi").select("id")
    all_ids = mine
    for _ in range(max_depth - 1):
        mine = rows.join(mine, "id", "left_semi").select(F.col("via_target").alias("id")).join(rows.select("id"), "id", "left_semi")
        all_ids = all_ids.unionByName(mine)
    return all_ids.distinct()


def entry_symbols(symbols: DataFrame, incoming: DataFrame) -> DataFrame:
    """``id``: where execution or use may enter."""
    joined = symbols.join(incoming, "id", "left")
    none = F.coalesce("n_incoming", F.lit(0)) == 0
    top = F.coalesce(F.size("scope"), F.lit(0)) <= 0
    inner = F.when(F.col("kind") == "variable", top | none).when(F.col("kind").isin("function", "method", "class"), True).otherwise(none)
    return joined.where(X.is_entry_file(F.col("file")) | (F.col("exported") & inner)).select("id")


def entry_paths(edges: DataFrame, changed: DataFrame, entries: DataFrame, max_depth: int = 3) -> DataFrame:
    """``changed_id, entry_id, depth, strength, hops``: shortest call paths from entries to each changed symbol.

    hops run from the entry: (from_id, to_id, file, line, strength). Of several shortest paths the strongest is kept, of
    those the first by the calls' order. A step joins pairs of caller and callee, not single calls, and aggregates numbers
    only; the hop of a symbol that was reached is looked up afterwards. The last step only looks for entries.
    """
    pairs = kept(_pairs(edges))
    links = pairs.select("source_id", "target_id", *[F.col(f"s{k}").isNotNull().alias(f"h{k}") for k in _STRENGTHS])
    hops = F.array().cast("array<struct<from_id:string,to_id:string,file:string,line:int,strength:int>>")
    front = changed.select(F.col("id").alias("changed_id"), "id", F.lit(3).alias("strength"), F.lit(1).alias("rank"), hops.alias("hops")).distinct()
    seen, out = front.select("changed_id", "id"), None
    for depth in range(1, max_depth + 1):
        near = links if depth < max_depth else links.join(entries.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        step = near.join(front.select("changed_id", "id", "strength", "rank"), F.col("target_id") == F.col("id")).groupBy("changed_id", "source_id").agg(*[_reached(k) for k in _STRENGTHS])
        step = step.join(seen.withColumnRenamed("id", "source_id"), ["changed_id", "source_id"], "left_anti")
        step = step.select("changed_id", "source_id", *_best())
        via = front.withColumnRenamed("id", "target_id")
        hop = _first_call(lambda c: F.least(c["edge"], F.col("strength")) == F.col("now"))
        found = step.join(via, ["changed_id", "rank"]).join(pairs, ["source_id", "target_id"]).withColumn("hop", hop)
        one = F.struct(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), F.col("hop.call_file").alias("file"), F.col("hop.call_line").alias("line"), F.col("hop.edge").alias("strength"))
        found = found.select("changed_id", F.col("source_id").alias("id"), F.col("now").alias("strength"), "before", F.concat(F.array(one), "hops").alias("hops"))
        if depth < max_depth:  # what comes first of the paths to a symbol orders it, whatever its strength
            order = found.select("changed_id", F.col("id").alias("source_id"), "before").join(via.select("changed_id", "target_id", F.col("rank").alias("before")), ["changed_id", "before"]).join(pairs, ["source_id", "target_id"])
            order = order.select("changed_id", F.col("source_id").alias("id"), _first_call(lambda c: F.lit(True))["seq"].alias("seq"))
            found = found.join(order, ["changed_id", "id"]).withColumn("rank", F.row_number().over(Window.partitionBy("changed_id").orderBy("before", "seq"))).drop("seq")
        found = kept(found.drop("before"))
        hit = found.join(entries, "id", "left_semi").select("changed_id", F.col("id").alias("entry_id"), F.lit(depth).alias("depth"), F.array_min(F.transform("hops", lambda h: h["strength"])).alias("strength"), "hops")
        out = hit if out is None else out.unionByName(hit)
        seen, front = seen.unionByName(found.select("changed_id", "id")), found
        if found.isEmpty():
            break
    return out


def cycles(graph: DataFrame) -> DataFrame:
    """``root, members``: import cycles (strongly connected sets of two or more), members sorted. graph: ``root, src, dst``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        links: dict[str, list[str]] = {}
        for a, b in zip(group["src"], group["dst"], strict=True):
            links.setdefault(a, []).append(b)
            links.setdefault(b, [])
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        stack: list[str] = []
        on: set[str] = set()
        found = []
        for root in sorted(links):
            if root in index:
                continue
            work = [(root, iter(links[root]))]
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
            while work:
                node, rest = work[-1]
                for to in rest:
                    if to not in index:
                        index[to] = low[to] = len(index)
                        stack.append(to)
                        on.add(to)
                        work.append((to, iter(links[to])))
                        break
                    if to in on:
                        low[node] = min(low[node], index[to])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == index[node]:
                        at = stack.index(node)
                        part, stack[at:] = stack[at:], []
                        on.difference_update(part)
                        if len(part) > 1:
                            found.append(sorted(part))
        return pd.DataFrame({"root": [group["root"].iloc[0]] * len(found), "members": sorted(found)})

    return graph.groupBy("root").applyInPandas(run, "root string, members array<string>")


def _least_reaching(links: DataFrame) -> DataFrame:
    """``root, n, c``: for each node of links (root, src, dst) the first node that reaches it, itself included.

    The order is that of hashes. A node takes the first of its own, its sources' and its own one's; in such an order the
    distance that it sees grows by half with each round, also along a chain.
    """
    ends = links.select("root", F.col("src").alias("n")).unionByName(links.select("root", F.col("dst").alias("n"))).distinct()
    colour = kept(ends.withColumn("c", F.struct(F.xxhash64("n").alias("h"), F.col("n").alias("n"))))
    while True:
        heard = links.join(colour.select("root", F.col("n").alias("src"), "c"), ["root", "src"]).groupBy("root", F.col("dst").alias("n")).agg(F.min("c").alias("heard"))
        far = colour.select("root", F.col("n").alias("at"), F.col("c").alias("far"))
        best = F.least("c", F.coalesce("heard", "c"), "far")
        found = colour.select("root", "n", "c", F.col("c.n").alias("at")).join(heard, ["root", "n"], "left").join(far, ["root", "at"])
        colour = kept(found.select("root", "n", best.alias("c"), (best < F.col("c")).alias("moved")), colour)
        if colour.where("moved").isEmpty():
            return colour.select("root", "n", F.col("c.n").alias("c"))


def cycles_distributed(graph: DataFrame) -> DataFrame:
    """The same sets for one graph too large for a worker.

    Each node gets the first node that reaches it and the first that it reaches. Where both are one node, that node's set is
    found. Links between nodes that differ in either can't be part of a cycle and go; the rest is done again.
    """
    left = kept(graph.select("root", "src", "dst").where("src <> dst").distinct())
    done = None
    while not left.isEmpty():
        into = _least_reaching(left)
        from_ = _least_reaching(left.select("root", F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = kept(into.withColumnRenamed("c", "f").join(from_.withColumnRenamed("c", "b"), ["root", "n"]))
        sets = both.where("f = b").groupBy("root", "f").agg(F.array_sort(F.collect_list("n")).alias("members")).where("size(members) > 1").select("root", "members")
        done = kept(sets if done is None else done.unionByName(sets), *([] if done is None else [done]))
        open_ = both.where("f <> b")
        ends = [open_.select("root", F.col("n").alias(c), F.col("f").alias(f"{c}_f"), F.col("b").alias(f"{c}_b")) for c in ("src", "dst")]
        left = kept(left.join(ends[0], ["root", "src"]).join(ends[1], ["root", "dst"]).where("src_f = dst_f AND src_b = dst_b").select("root", "src", "dst"), left)
    return done if done is not None else graph.select("root", F.array("src").alias("members")).limit(0)


def large_roots(rows: DataFrame, most: int) -> DataFrame | None:
    """``root`` of the graphs with more than so many links; None if there are none."""
    large = kept(rows.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most).select("root"))
    return None if large.isEmpty() else large


def ranked(nodes: DataFrame, edges: DataFrame, *, worker_links: int = S.WORKER_LINKS, **options) -> DataFrame:
    """``root, path, rank``: graphs of up to worker_links links run each in one group, larger ones distributed."""
    large = large_roots(edges, worker_links)
    if large is None:
        return pagerank(nodes, edges, **options)
    of = lambda df, how: df.join(large, "root", how)
    return pagerank(of(nodes, "left_anti"), of(edges, "left_anti"), **options).unionByName(pagerank_distributed(of(nodes, "left_semi"), of(edges, "left_semi"), **options))


def import_cycles(graph: DataFrame, *, worker_links: int = S.WORKER_LINKS) -> DataFrame:
    """``root, members``: graphs of up to worker_links links run each in one group, larger ones distributed."""
    large = large_roots(graph, worker_links)
    if large is None:
        return cycles(graph)
    return cycles(graph.join(large, "root", "left_anti")).unionByName(cycles_distributed(graph.join(large, "root", "left_semi")))


def degrees(paths: DataFrame, graph: DataFrame) -> DataFrame:
    """``path, n_out, n_in`` of the module graph."""
    out = graph.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_out"))
    into = graph.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return paths.select("path").join(out, "path", "left").join(into, "path", "left").select("path", zero("n_out"), zero("n_in"))


def orphans(files: DataFrame, symbols: DataFrame, graph: DataFrame) -> DataFrame:
    """``path, n_symbols``: files with declarations that nothing imports and that import nothing, no entries or tests."""
    count = symbols.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n_symbols"))
    alone = files.select("path").join(graph.select(F.col("src").alias("path")), "path", "left_anti").join(graph.select(F.col("dst").alias("path")), "path", "left_anti")
    rows = alone.where(~X.is_entry_file(F.col("path"), wide=True) & ~X.is_test_path(F.col("path")))
    return rows.join(count, "path")


def repo_map(symbols: DataFrame, ranks: DataFrame, densities: DataFrame, *, files: int = S.MAP_FILES, per_file: int = S.MAP_SYMBOLS) -> DataFrame:
    """``path, score, n_symbols, symbols``: the top files by density and PageRank, with their first declarations."""
    from pyspark.sql.window import Window

    score = F.col("density") + S.PAGERANK_WEIGHT * F.coalesce("rank", F.lit(0.0))
    top = densities.join(ranks.select("path", "rank"), "path", "left").select("path", score.alias("score"), "n_symbols").orderBy(F.desc("score"), "path").limit(files)
    order = F.row_number().over(Window.partitionBy("file").orderBy("seq"))
    first = symbols.join(top.select(F.col("path").alias("file")), "file", "left_semi").withColumn("n", order).where(F.col("n") <= per_file)
    listed = first.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("seq", "name", "kind", "line"))).alias("symbols"))
    return top.join(listed, "path", "left").orderBy(F.desc("score"), "path")
