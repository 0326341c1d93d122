"""Operators against brute force, known numbers and invariants."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from urlsieve.operators import crawl as C, explain as X, lookups as L, metrics as M, pages as P, ranks as R, splits as S


def scores(spark, n=3000, seed=1, values=None):
    rng = random.Random(seed)
    rows = [(i, rng.choice(values) if values else rng.random(), int(rng.random() < 0.3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, score double, label int")


# --- metrics ------------------------------------------------------------------------------

@pytest.mark.parametrize("tp,fp,tn,fn,f1,p,r", [
    (393492, 229, 1574023, 72, 0.9996176733965464, 0.9994183698608914, 0.9998170564380888),
    (393559, 3975, 1570277, 5, 0.994969017744957, 0.9900008552727565, 0.9999872955859784),
    (389629, 36, 1574216, 3935, 0.9949299630120948, 0.9999076129495849, 0.9900016261649948),
])
def test_published_rates(spark, tp, fp, tn, fn, f1, p, r):
    df = spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")
    row = M.with_rates(df).first()
    assert math.isclose(row["f1"], f1) and math.isclose(row["precision"], p) and math.isclose(row["recall"], r)
    assert math.isclose(row["fpr"], fp / (fp + tn))


@pytest.mark.parametrize("values", [None, [0.1, 0.5, 0.9]])
def test_areas_match_pair_counting(spark, values):
    rows, df = scores(spark, 600, values=values)
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap = prev = 0.0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(q >= t for q in neg)
        ap += (tp / len(pos) - prev) * tp / (tp + fp)
        prev = tp / len(pos)
    got = M.curve_areas(df).first()
    assert math.isclose(got["roc_auc"], auc, rel_tol=1e-9) and math.isclose(got["pr_auc"], ap, rel_tol=1e-9)


def test_sweep_counts_scores_on_the_grid(spark):
    rows = [(k / 100, k % 2) for k in range(101)] + [(1.5, 1), (-0.5, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in M.threshold_sweep(df).collect()}
    assert len(got) == 99
    for t, counts in got.items():
        hit = [y for s, y in rows if s >= t]
        miss = [y for s, y in rows if s < t]
        assert counts == (sum(hit), len(hit) - sum(hit), sum(miss), len(miss) - sum(miss))


def test_sweep_is_monotone(spark):
    _, df = scores(spark)
    rows = M.threshold_sweep(df).orderBy("threshold").collect()
    assert all(a["tp"] >= b["tp"] and a["fp"] >= b["fp"] for a, b in zip(rows, rows[1:]))


def test_early_stop(spark):
    metrics = [0.1, 0.5, 0.4, 0.5, 0.5000001, 0.9]
    df = spark.createDataFrame([("r", e, m) for e, m in enumerate(metrics)], "run string, epoch int, metric double")
    row = M.early_stop(df, patience=3).first()
    assert (row["best_epoch"], row["best_metric"], row["stopped_epoch"]) == (1, 0.5, 4)
    assert M.early_stop(df, patience=10).first()["best_epoch"] == 5


def test_smoothed_rows_have_the_smoothed_loss(spark):
    df = spark.createDataFrame([(0.3, 1), (-1.2, 0), (2.0, 0)], "logit double, label int")
    loss = M.smoothed_bce(df, pos_weight=4.0).first()["loss"]
    pairs = M.smoothed_rows(df, pos_weight=4.0).collect()
    direct = sum(r["weight"] * math.log(1 + math.exp(-r["logit"] if r["label"] else r["logit"])) for r in pairs) / 3
    assert math.isclose(loss, direct)


# --- ranks and splits ---------------------------------------------------------------------

def test_running_sum_matches_window(spark):
    rng = random.Random(3)
    rows = [("ab"[i % 2], rng.random(), rng.randint(-5, 5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, v int, i int")
    got = R.running(df, [F.col("x")], F.floor(F.col("x") * 7), ["g"], {"s": F.col("v")}, {"m": F.col("v")}).collect()
    for r in got:
        upto = [v for g, x, v, _ in rows if g == r["g"] and x <= r["x"]]
        assert r["s"] == sum(upto) and r["m"] == max(upto)


def test_depth_buckets_grow_with_the_value(spark):
    df = spark.createDataFrame([(float(i % 700),) for i in range(2000)], "x double")
    rows = sorted((r["x"], r["_depth"]) for r in R.bucket_by_depth(df, "x", bits=5).collect())
    depths = [d for _, d in rows]
    assert depths == sorted(depths) and len(set(depths)) >= 30
    assert all(len({d for x, d in rows if x == v}) == 1 for v in (0.0, 350.0, 699.0))


@pytest.mark.parametrize("partitions", [1, 8])
def test_random_split_is_floor_exact_and_stable(spark, partitions):
    rows = [(i, int(i % 7 == 0)) for i in range(1003)]
    df = spark.createDataFrame(rows, "id int, label int").repartition(partitions)
    out = {r["id"]: r["split"] for r in S.random_split(df, ["id"]).collect()}
    assert len(out) == len(rows)
    for label in (0, 1):
        ids = sorted((hashlib.md5(f"{i}|42".encode()).hexdigest(), i) for i, y in rows if y == label)
        n = len(ids)
        a, b = math.floor(0.8 * n), math.floor(0.8 * n) + math.floor(0.1 * n)
        want = {i: "train" if k < a else "val" if k < b else "test" for k, (_, i) in enumerate(ids)}
        assert all(out[i] == s for i, s in want.items())


def test_balance_is_exact_and_checks_supply(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in S.balance(df, ["id"]).groupBy("label").count().collect()}
    assert counts == {0: 400, 1: 100}
    short = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("label"))
    with pytest.raises(Exception, match="not enough benign rows"):
        S.balance(short, ["id"]).collect()


def greedy(sizes, shares=(0.8, 0.1, 0.1)):
    left = [s * sum(sizes) for s in shares]
    out = []
    for size in sorted(sizes, reverse=True):
        best = max(range(3), key=lambda i: (left[i], -i))
        left[best] -= size
        out.append((size, best))
    return Counter(out)


def test_equal_items_are_dealt_like_one_by_one():
    rng = random.Random(5)
    for _ in range(300):
        left = [rng.uniform(-50, 3000) for _ in range(3)]
        size, count = rng.randint(1, 40), rng.randint(1, 400)
        want, state = [0, 0, 0], list(left)
        for _ in range(count):
            best = max(range(3), key=lambda i: (state[i], -i))
            state[best] -= size
            want[best] += 1
        assert S.deal_equal_items(left, size, count) == want


def test_domain_split_with_a_giant_domain(spark):
    rng = random.Random(7)
    rows = [("giant.com", 0)] * 3000
    for d in range(900):
        rows += [(f"d{d}.com", int(d % 3 == 0))] * min(int(rng.paretovariate(1.1)), 400)
    df = spark.createDataFrame([(i, d, y) for i, (d, y) in enumerate(rows)], "id int, domain string, label int")
    out = S.domain_split(df).collect()
    assert len(out) == len(rows) and all(r["split"] for r in out)
    splits = defaultdict(set)
    for r in out:
        splits[r["domain"]].add(r["split"])
    assert all(len(s) == 1 for s in splits.values())
    names = ("train", "val", "test")
    for majority in (0, 1):
        sizes = Counter(d for d, y in rows if y == majority)
        got = Counter((n, names.index(next(iter(splits[d])))) for d, n in sizes.items())
        assert got == greedy(list(sizes.values()))


# --- lookups ------------------------------------------------------------------------------

@pytest.mark.parametrize("share,limit", [(3, 0), (2000, 0), (3, 1 << 20)])
def test_lookup_join_is_a_left_join(spark, share, limit):
    keys = ["hot"] * 400 + [f"k{i % 50}" for i in range(200)] + [None] * 10 + ["absent"] * 5
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    dim = spark.createDataFrame([("hot", 1, "x")] + [(f"k{i}", i, None) for i in range(50)], "k string, v int, w string")
    got = sorted(map(tuple, L.lookup_join(rows, dim, "k", share=share, limit=limit).collect()))
    assert got == sorted(map(tuple, rows.join(dim, "k", "left").select("i", "k", "v", "w").collect()))


@pytest.mark.parametrize("limit", [0, 100, 1 << 20])  # salted copies of the hot part, a broadcast of it, a broadcast of all
def test_lookup_join_with_clashing_names(spark, limit):
    names = ["_hot", "_HOT_KEY", "_cold", "_salt", "_cold_salt", "_cold_key"]
    rows = spark.createDataFrame([(f"k{i % 3 if i < 300 else i % 40}", *range(6)) for i in range(400)], "k string, " + ", ".join(f"{n} int" for n in names))
    dim = spark.createDataFrame([(f"k{i}", i) for i in range(30)], "k string, v int")
    got = sorted(map(repr, L.lookup_join(rows, dim, "k", share=3, limit=limit).collect()))
    assert got == sorted(map(repr, rows.join(dim, "k", "left").select("k", *names, "v").collect()))


def test_broadcasts_are_measured_in_bytes(spark):
    assert L.stored_bytes(spark.createDataFrame([("é" * 100,)], "x string")) > 200 and L.stored_bytes(spark.createDataFrame([], "x string")) == 0


def test_longest_suffix(spark):
    hosts = ["a.b.co.uk", "co.uk", "uk", "x.uk", "none", "", "b.city.kawasaki.jp"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("jp",), ("city.kawasaki.jp",)], "suffix string")
    got = {r["host"]: r["suffix"] for r in L.longest_suffix(rows, "host", suffixes).collect()}
    assert got == {"a.b.co.uk": "co.uk", "co.uk": "co.uk", "uk": "uk", "x.uk": "uk", "none": None, "": None,
                   "b.city.kawasaki.jp": "city.kawasaki.jp"}


# --- crawl --------------------------------------------------------------------------------

def test_reach_with_a_hub(spark):
    rng = random.Random(11)
    edges = [("http://h.com/", f"http://h.com/{i}") for i in range(300)]
    edges += [(f"http://h.com/{rng.randint(0, 299)}", f"http://h.com/n{rng.randint(0, 99)}") for _ in range(200)]
    edges += [(f"http://h.com/n{i}", "http://h.com/") for i in range(50)] + [("http://h.com/1", "http://other.com/")]
    graph = defaultdict(set)
    for a, b in edges:
        graph[a].add(b)
    seeds = ["http://h.com/", "http://h.com/n3"]
    want = {}
    for s in seeds:
        level, seen = {s}, {s: 0}
        for depth in range(1, 4):
            level = {b for a in level for b in graph[a] if b not in seen and "//h.com" in b}
            seen.update(dict.fromkeys(level, depth))
        want.update({(s, u): d for u, d in seen.items()})
    got = C.reach(spark.createDataFrame(edges, "src string, dst string"),
                  spark.createDataFrame([(s, s) for s in seeds], "seed string, url string"))
    rows = [(r["seed"], r["url"], r["depth"]) for r in got.collect()]
    assert len(rows) == len(want) and {(s, u): d for s, u, d in rows} == want


def test_polite_schedule(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"h{i % 9}", float(rng.randint(0, 200))) for i in range(400)]
    got = {r["id"]: r["start"] for r in C.polite_schedule(
        spark.createDataFrame(rows, "id int, host string, arrival double"), "id", gap=2.0, chunks=7).collect()}
    last = {}
    for i, host, arrival in sorted(rows, key=lambda r: (r[2], r[0])):
        last[host] = max(arrival, last.get(host, -1e9) + 2.0)
        assert math.isclose(got[i], last[host])


def test_polite_schedule_of_one_host_and_one_second(spark):
    """All rows on one host at one moment are still dealt over all chunks."""
    rows = spark.range(2000).select("id", F.lit("h").alias("host"), F.lit(5.0).alias("arrival"))
    plan = C.polite_schedule(rows, "id", gap=0.5, chunks=8)
    assert {r["id"]: r["start"] for r in plan.collect()} == {i: 5.0 + 0.5 * i for i in range(2000)}
    sizes = [r["count"] for r in rows.repartitionByRange(8, "host", "arrival", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 2000 / 8
    assert C.polite_schedule(rows.limit(0), "id").count() == 0


def test_robots_first_rule_wins(spark):
    body = "# c\nUser-agent: *\nDisallow: /\n\nUser-agent: A\nuser-agent: ResearchBot\nAllow: /p/ok\nDisallow: /p\n"
    rules = P.robots_rules(spark.createDataFrame([("h", body), ("o", "User-agent: *\nDisallow:\n")], "host string, body string"))
    urls = spark.createDataFrame([("h", "/p/ok/1"), ("h", "/p/x"), ("h", "/q"), ("o", "/p"), ("none", "/p")], "host string, path string")
    mine = {(r["host"], r["path"]): r["allowed"] for r in P.robots_filter(urls, rules, "ResearchBot/0.1").collect()}
    assert mine == {("h", "/p/ok/1"): True, ("h", "/p/x"): False, ("h", "/q"): True, ("o", "/p"): True, ("none", "/p"): True}
    other = {r["path"]: r["allowed"] for r in P.robots_filter(urls.where("host = 'h'"), rules, "Other").collect()}
    assert not any(other.values())


def test_robots_groups_end_at_empty_lines(spark):
    body = "User-agent: bot\n\nDisallow: /lost\nUser-agent: x\nUser-agent: researchbot\nDisallow: /a\n\nUser-agent: search\nDisallow: /b\n\nUser-agent: *\nDisallow: /\n"
    rules = P.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"))
    urls = spark.createDataFrame([("h", p) for p in ("/lost", "/a", "/b")], "host string, path string")
    allowed = {r["path"]: r["allowed"] for r in P.robots_filter(urls, rules, "ResearchBot/1").collect()}
    assert allowed == {"/lost": True, "/a": False, "/b": True}


# --- pages --------------------------------------------------------------------------------

def test_ngrams_count_code_points(spark):
    df = spark.createDataFrame([("a😀bc",), ("ab",), ("",), ("a\nbc",)], "h string")
    assert [r[0] for r in df.select(P.char_ngrams(F.col("h"), 3)).collect()] == [["a😀b", "😀bc"], [], [], ["a\nb", "\nbc"]]


def test_ngrams_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 5)
    body = "".join(chr(97 + i % 26) for i in range(33)) + "😀é"
    df = spark.createDataFrame([(1, body), (2, "ab"), (3, "")], "id int, h string")
    got = Counter()
    for r in P.ngram_counts(df, "id", "h").collect():
        got[(r["id"], r["gram"])] += r["n"]
    assert got == Counter((1, body[i:i + n]) for n in (3, 4) for i in range(len(body) - n + 1))


def test_normalize_html(spark):
    df = spark.createDataFrame([(" <a>\n\t<b>  x \u00a0 y </b> ",), (None,), ("a" * 30,)], "h string")
    assert [r[0] for r in df.select(P.normalize_html(F.col("h"))).collect()] == ["<a><b> x y </b>", "", "a" * 30]
    assert [r[0] for r in df.select(P.normalize_html(F.col("h"), 4)).collect()] == ["<a><", "", "aaaa"]


def test_hrefs(spark):
    html = "<a href='/x?a=1&amp;b'>1</a><!-- <a href=/no> --><script>'<a href=\"/no\">'</script><A class=c HREF=/y>2</A><a name=z><link href=/no>"
    assert spark.createDataFrame([(html,)], "h string").select(P.hrefs(F.col("h"))).first()[0] == ["/x?a=1&b", "/y"]


def test_block_weights(spark):
    df = spark.createDataFrame([(1, "abcdefgh")], "id int, url string")
    weights = spark.createDataFrame([("abc", 1.0), ("def", 2.0), ("efg", 4.0)], "gram string, weight double")
    blocks = X.block_weights(df, weights, ("id",))
    assert {r["block"]: r["weight"] for r in blocks.collect()} == {0: 3.0, 1: 4.0}
    top = X.top_blocks(blocks, ("id",), k=1).first()
    assert (top["block"], top["snippet"], top["weight"]) == (1, "efgh", 4.0)


def test_null_keys_and_scores_are_counted_one_way(spark):
    from urlsieve.operators import crawl, splits

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "id long, label int")
    assert splits.random_split(rows, keys=["id"]).count() == 100
    asks = spark.createDataFrame([(1, "h", 0.0), (2, None, 0.0), (3, None, 0.1)], "id long, host string, arrival double")
    assert crawl.polite_schedule(asks, "id").count() == 3
    scored = spark.createDataFrame([(None, 0), (float("nan"), 0), (0.2, 0), (0.9, 1), (0.5, None)], "score double, label int")
    sweep = {r["threshold"]: r for r in M.threshold_sweep(scored).collect()}[0.99]
    point = M.confusion(scored, 0.99).first()
    for r in (sweep, point):
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (0, 0, 1, 1)
    assert {(r["n_pos"], r["n_neg"]) for r in M.cumulative(scored).collect()} == {(1, 1)}


# --- walks whose ways are long ------------------------------------------------------------

def _walked(edges, seeds, max_depth=None):
    out, after = {}, defaultdict(set)
    for a, b in edges:
        if a != b and b is not None:
            after[a].add(b)
    for seed, url in seeds:
        level, depth = {url}, 0
        while level and (max_depth is None or depth <= max_depth):
            for u in level:
                out[seed, u] = min(depth, out.get((seed, u), depth))
            level, depth = {v for u in level for v in after[u] if out.get((seed, v), depth + 2) > depth + 1}, depth + 1
    return out


@pytest.mark.parametrize("block_links,cells,max_depth", [(1 << 18, 1 << 22, None), (20, 60, None), (20, 60, 6)])
def test_far_walk_is_exact_for_any_blocks(spark, block_links, cells, max_depth):
    rng = random.Random(5)
    names = [f"u{i:03d}" for i in range(60)]
    edges = [(names[i], names[i + 1]) for i in range(40)] + [(rng.choice(names), rng.choice(names)) for _ in range(30)]
    edges += [("u001", None), ("u002", "u002"), ("u040", "u001")]
    seeds = [(s, s) for s in names[::7]] + [("two", "u003"), ("two", "u035"), ("alone", "alone")]
    got = C.reach_far(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "seed string, url string"),
                      max_depth, block_links=block_links, cells=cells).collect()
    want = _walked(edges, seeds, max_depth)
    assert len(got) == len(want) and {(r["seed"], r["url"]): r["depth"] for r in got} == want


def test_sitemap_chain_takes_few_jobs(spark):
    n, group = 150, "sitemap-chain"
    maps = spark.createDataFrame([(f"m{i:04d}",) for i in range(n) if i != 7], "sitemap_url string")
    kids = spark.createDataFrame([(f"m{i:04d}", f"m{i + 1:04d}") for i in range(n)], "src string, dst string")
    roots = spark.createDataFrame([("m0000", "m0000")], "seed string, url string")
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = C.sitemap_tree(maps, roots, kids).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["sitemap_url"]: r["depth"] for r in got} == {f"m{i:04d}": i for i in range(n) if i != 7}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < n


# --- partitions of rows that grow manyfold ------------------------------------------------

def test_spread_bounds_the_rows_of_a_partition(spark):
    from urlsieve.session import spread

    few = spark.range(1000).coalesce(1)
    sizes = spread(few, 20).rdd.glom().map(len).collect()
    assert len(sizes) == 50 and max(sizes) <= 40
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 1000, 1, 70), 20).rdd.getNumPartitions() == 70


def test_pieces_of_urls_stay_in_as_many_partitions(spark):
    rows = spark.range(64).selectExpr("id", "concat('http://h', id, '.com/') AS url").repartition(16)
    weights = spark.createDataFrame([("htt", 1.0)], "gram string, weight double")
    assert X.block_weights(rows, weights, ("id",)).rdd.getNumPartitions() == 16


def test_pieces_of_pages_stay_in_as_many_partitions(spark):
    rows = spark.range(64).selectExpr("id", "concat('<p>', id, '</p>') AS h").repartition(16)
    assert P.ngram_counts(rows, "id", "h").rdd.getNumPartitions() == 16
