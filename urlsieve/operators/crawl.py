"""Link graphs and crawl planning."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions.urls import Rules, with_site
from urlsieve.operators.lookups import hot_keys, lookup_join
from urlsieve.operators.pages import cap_per_group
from urlsieve.session import cut_lineage

SALTS = 64
# links of one block of a far walk, and (seed, url) cells that one task holds
BLOCK_LINKS, WALK_CELLS = 1 << 18, 1 << 22
_FAR = np.iinfo(np.int32).max
_STATE = "seed_id long, node_id long, depth int, fresh boolean"


def reach(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, on_site: bool = True, rules: Rules | None = None
) -> DataFrame:
    """seed, url, depth: what a breadth-first walk from each seed finds, at its least depth.

    The walk ends when a level finds nothing new, or at ``max_depth`` where one is given.

    ``edges`` has src and dst, ``seeds`` has seed and url. Every level is one join with the edges
    and one anti-join with what is known; it is checkpointed, so plans stay short and a lost
    executor costs one level. Out-links of hub pages are salted: each hub's links are spread over
    many tasks and only the hub's few frontier rows are repeated.
    """
    links = edges.select("src", "dst").where("dst IS NOT NULL AND src <> dst").distinct()
    # the site of a target is found once here, not again at every level and for every seed
    links = with_site(links, "dst", "dst_site", rules) if on_site else links.withColumn("dst_site", F.lit(""))
    if on_site:  # a walk stays on its site, so only links between pages of one site can take part
        links = with_site(links, "src", "src_site", rules).where("src_site = dst_site").drop("src_site")
    links = cut_lineage(links)
    # at most HOT_SHARE hubs exist, see hot_keys
    hubs = cut_lineage(hot_keys(links, "src").select(F.col("src").alias("_hub")))
    salted = links.join(F.broadcast(hubs), F.col("src") == F.col("_hub"), "left").select(
        "src", "dst", "dst_site",
        F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64("dst"), F.lit(SALTS)))
        .otherwise(0).cast("int").alias("_salt"))
    known = seeds.select("seed", "url").distinct().withColumn("depth", F.lit(0))
    if on_site:
        known = with_site(known, "seed", "_site", rules)
    known = frontier = cut_lineage(known)
    keep = [c for c in known.columns if c not in ("url", "depth")]
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        # a hub's frontier rows are repeated once per salt
        probes = frontier.join(F.broadcast(hubs), F.col("url") == F.col("_hub"), "left").select(
            *keep, "url",
            F.explode(F.when(F.col("_hub").isNull(), F.array(F.lit(0)))
                      .otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("_probe"))
        step = probes.join(
            salted, (F.col("url") == F.col("src")) & (F.col("_probe") == F.col("_salt"))
        )
        if on_site:
            step = step.where("dst_site = _site")
        step = step.select(*keep, F.col("dst").alias("url"))
        fresh = step.distinct().join(known.select("seed", "url"), ["seed", "url"], "left_anti")
        frontier = cut_lineage(fresh.withColumn("depth", F.lit(depth)).select(known.columns))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.select("seed", "url", "depth")


def numbered(df: DataFrame, column: str, name: str, parts: int) -> DataFrame:
    """A stored table of the distinct values with a number each: the part in the high bits, the place in it in the low 33."""
    rows = df.select(column).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    return cut_lineage(rows.withColumn(name, F.monotonically_increasing_id()))


def _part(number: str) -> Column:
    return F.shiftright(number, 33).cast("int")


def walk_block(max_depth: int | None) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Walk one block of links for one group of seeds until nothing in it changes.

    Fresh depths are followed level by level; what leaves the block comes back as fresh depths of other blocks.
    """
    limit = _FAR if max_depth is None else max_depth

    def run(key: tuple, state: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(links):
            return state[["seed_id", "node_id", "depth", "fresh"]].assign(fresh=False)
        seeds, seed_at = np.unique(state["seed_id"].to_numpy(), return_inverse=True)
        src, dst = links["src_id"].to_numpy(), links["dst_id"].to_numpy()
        nodes = np.unique(np.concatenate([src, dst, state["node_id"].to_numpy()]))
        width = len(nodes)
        order = np.argsort(src, kind="stable")
        target = np.searchsorted(nodes, dst[order])
        start = np.searchsorted(src[order], nodes, "left")
        degree = np.searchsorted(src[order], nodes, "right") - start
        cell = seed_at * width + np.searchsorted(nodes, state["node_id"].to_numpy())
        depth = np.full(len(seeds) * width, _FAR, np.int32)
        depth[cell] = state["depth"].to_numpy()
        fresh = cell[state["fresh"].to_numpy(bool)]
        fresh = fresh[np.argsort(depth[fresh], kind="stable")]
        given, used, front, level = depth[fresh], 0, fresh[:0], 0
        while used < len(fresh) or len(front):
            if not len(front):
                level = int(given[used])
            until = int(np.searchsorted(given, level, "right"))
            joined = np.concatenate([front, fresh[used:until]])
            used = until
            if level >= limit:
                break
            joined = np.unique(joined[depth[joined] == level])  # others were reached on a shorter way
            at = joined % width
            n = degree[at]
            ends = np.cumsum(n)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - ends + n, n)
            found = np.repeat(joined - at, n) + target[place]
            front = np.unique(found[depth[found] > level + 1])
            level += 1
            depth[front] = level
        known = np.flatnonzero(depth < _FAR)
        node = nodes[known % width]
        leaf = np.zeros(width, bool)
        leaf[np.searchsorted(nodes, dst[links["leaf"].to_numpy(bool)])] = True
        return pd.DataFrame({"seed_id": seeds[known // width], "node_id": node, "depth": depth[known],
                             "fresh": (node >> 33 != key[0]) & ~leaf[known % width]})

    return run


def reach_far(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, within: DataFrame | None = None,
    block_links: int = BLOCK_LINKS, cells: int = WALK_CELLS,
) -> DataFrame:
    """What :func:`reach` finds off-site, for graphs whose ways are long: rounds grow with blocks, not with depth.

    URLs are numbered in order and cut into blocks of about ``block_links`` links, seeds into groups of
    ``cells`` (seed, URL) pairs a block at most. A round is one cogroup: each (block, group) with fresh
    depths walks its links to the end in arrays of that size, and the depths that leave it are fresh in the next
    round where they are less than what is known. It ends when none are. The links of one index stay
    together, as they do in its document. ``within`` (url) keeps only these in the result.
    """
    links = cut_lineage(edges.select("src", "dst").where("dst IS NOT NULL AND src <> dst").distinct())
    roots = cut_lineage(seeds.select("seed", "url").where("url IS NOT NULL").distinct())
    blocks = max(1, -(-links.count() // block_links))
    urls = links.select(F.col("src").alias("url")).union(links.select("dst")).union(roots.select("url"))
    nodes = numbered(urls, "url", "node_id", blocks)
    inner = links.select(F.col("src").alias("url")).distinct().withColumn("inner", F.lit(True))
    kinds = nodes.join(inner, "url", "left").select("url", "node_id", F.col("inner").isNull().alias("leaf"))
    kinds = cut_lineage(kinds)
    arcs = lookup_join(links.withColumnRenamed("src", "url"), kinds.select("url", F.col("node_id").alias("src_id")), "url")
    arcs = lookup_join(arcs.select("src_id", F.col("dst").alias("url")), kinds.select("url", F.col("node_id").alias("dst_id"), "leaf"), "url")
    arcs = cut_lineage(arcs.select(_part("src_id").alias("block"), "src_id", "dst_id", "leaf"))
    # a block's own URLs and those that its links lead to
    widest = arcs.groupBy("block").agg(F.countDistinct("dst_id").alias("n")).agg(F.max("n")).first()[0] or 0
    widest += nodes.groupBy(_part("node_id").alias("block")).count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-roots.select("seed").distinct().count() * widest // cells))
    starts = numbered(roots, "seed", "seed_id", groups)
    state = lookup_join(roots, starts, "seed").join(kinds, "url").select(
        "seed_id", "node_id", F.lit(0).alias("depth"), (~F.col("leaf")).alias("fresh"))
    state = cut_lineage(state)
    keys = (_part("node_id").alias("block"), _part("seed_id").alias("grp"))
    while True:
        active = cut_lineage(state.where("fresh").select(*keys).distinct())
        if active.isEmpty():
            break
        keyed = state.select("*", *keys)
        work = keyed.join(active, ["block", "grp"], "left_semi").groupBy("block", "grp").cogroup(
            arcs.join(active, "block").groupBy("block", "grp"))
        step = work.applyInPandas(walk_block(max_depth), _STATE)
        if blocks > 1:
            rest = keyed.join(active, ["block", "grp"], "left_anti").drop("block", "grp")
            # where a known depth equals a fresh one, the known one is taken
            step = step.unionByName(rest).groupBy("seed_id", "node_id").agg(
                F.min(F.struct("depth", "fresh")).alias("best")).select("seed_id", "node_id", "best.*")
        state = cut_lineage(step)
    if within is not None:
        nodes = nodes.join(within.select("url").distinct(), "url", "left_semi")
        state = lookup_join(state, nodes, "node_id").where("url IS NOT NULL")
    else:
        state = lookup_join(state, nodes, "node_id")
    return lookup_join(state.drop("fresh"), starts, "seed_id").select("seed", "url", "depth")


def polite_schedule(
    requests: DataFrame, key: str, host: str = "host", arrival: str = "arrival",
    gap: float = K.REQUEST_GAP_SECONDS, chunks: int | None = None,
) -> DataFrame:
    """Add ``start``: when each request may run so that a host sees them at least ``gap`` apart.

    A request starts when it arrives or one gap after the previous start, whichever is later.
    Unrolled, start_k = gap k + max over j <= k of (arrival_j - gap j), a scan in max-plus algebra. Rows
    are dealt in order into chunks of about equal size, whatever a host or a second holds; what a chunk
    does to the rows behind it is a pair (rows, max of arrival - gap x rank), pairs combine
    associatively, and rows are finished inside their chunk from the pair of all chunks before it.
    """
    by = [host, arrival, key]
    dealt = requests.repartitionByRange(*by) if chunks is None else requests.repartitionByRange(chunks, *by)
    # the place in its partition is the row's identifier; stored, so that both passes see the same chunks
    rows = cut_lineage(dealt.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    chunk, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    late = F.col(arrival) - place * F.lit(gap)
    pairs = rows.groupBy(F.col(host).alias("_host"), chunk.alias("_chunk")).agg(
        F.min(place).alias("_first"), F.count("*").alias("_n"), F.max(late).alias("_late"))
    before = Window.partitionBy("_host").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # a host has at most one pair per chunk
    counted = pairs.withColumn("_rows", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    shift = (F.col("_first") - F.col("_rows")) * F.lit(gap)  # from places in the chunk to ranks of the host
    scanned = counted.select(
        "_host", "_chunk", (F.col("_rows") - F.col("_first") + 1).alias("_from"),
        F.max(F.col("_late") + shift - gap).over(before).alias("_peak"))
    met = rows.join(scanned, F.col(host).eqNullSafe(F.col("_host")) & (chunk == F.col("_chunk")))
    rank = (F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_from")) * F.lit(gap)
    inside = Window.partitionBy(host, "_chunk").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.greatest(F.max(F.col(arrival) - rank).over(inside), F.col("_peak")) + rank
    return met.select(*requests.columns, start.alias("start")).withColumn("wait", F.col("start") - F.col(arrival))


def seed_summary(rows: DataFrame) -> DataFrame:
    """Per seed: hosts, sitemap URLs, crawled URLs beyond them, and URLs new to the whole crawl.

    ``rows`` has seed, host, url, source (``sitemap`` or ``crawl``). A URL found by several seeds
    is new for the first one in seed order.
    """
    is_map = (F.col("source") == "sitemap").cast("int")
    per_url = rows.groupBy("seed", "host", "url").agg(F.max(is_map).alias("listed"))
    owner = rows.groupBy("url").agg(F.min("seed").alias("seed"))
    new = owner.groupBy("seed").agg(F.count("*").alias("new_urls_written"))
    counts = per_url.groupBy("seed", "host").agg(
        F.sum("listed").alias("_maps"), F.sum(1 - F.col("listed")).alias("_crawl"))
    per_seed = counts.groupBy("seed").agg(
        F.count("*").alias("hosts_processed"), F.sum("_maps").alias("sitemap_urls"),
        F.sum("_crawl").alias("crawl_urls"))
    return per_seed.join(new, "seed", "left").fillna(0, ["new_urls_written"])


def needs_crawl(hosts: DataFrame, sitemap: DataFrame, fewer_than: int) -> DataFrame:
    """Hosts whose sitemaps list too few URLs, so that their pages are crawled as well."""
    listed = sitemap.groupBy("host").agg(F.countDistinct("url").alias("sitemap_urls"))
    return hosts.select("host").distinct().join(listed, "host", "left").fillna(
        0, ["sitemap_urls"]).where(F.col("sitemap_urls") < fewer_than)


def sitemap_tree(maps: DataFrame, roots: DataFrame, children: DataFrame, cap: int | None = None,
                 max_depth: int | None = None) -> DataFrame:
    """seed, sitemap_url, depth: sitemaps reached from a host's roots through index files.

    ``children`` has src and dst (an index and a sitemap it lists). Only sitemaps that exist in
    ``maps`` count; ``cap`` asks for the nearest ones of each host.
    """
    present = maps.select(F.col("sitemap_url").alias("url")).distinct()
    children = cut_lineage(children.select("src", "dst"))
    # other targets are only needed on the way to sitemaps
    useful = present.union(children.select("src")).distinct()
    kept = children.join(useful.withColumnRenamed("url", "dst"), "dst", "left_semi")
    found = reach_far(kept, roots, max_depth, present)
    named = found.select("seed", F.col("url").alias("sitemap_url"), "depth")
    return named if cap is None else cap_per_group(named, ["seed"], ["depth", "sitemap_url"], cap)

