"""Prefix BPE, token alignment and the manifest against the libraries and brute force, with odd rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

from urlsieve.llm import alignment, manifest, prefix_bpe, queries

SF = "/root/testdata/sf0.001"
RANKS, BPE, PIECES = (tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, ids int, _key string, root string, pairs int"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b", None), (4, "One two", "b"), (4, "One two", "b"), (None, "null key\ntext", "c"),
    (None, None, None), (5, LONG, "a"), (7, "é日本 😀 <|endoftext|> x", "b"), (8, "a▁b", "b"), (9, "x" * 3000 + " " * 50 + "\n\n", "a"),
    (10, "nul \x00 and ­ soft", "z"), (11, "it's we're\n\n  'tis", "é"), (4, "One three", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", None, 1, "clash", "clash", 2) for r in ODD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- prefix BPE ---------------------------------------------------------------------------

def test_prefix_bpe_gives_the_library_ids(docs, real, none, library):
    for df in (docs, real):
        got = prefix_bpe.round_trips(df, RANKS, tokenizers.PATTERN)
        assert got.columns == ["doc_id", "ids", "decoded"]
        want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in df.collect())
        assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got.collect()) == want
        columns = df.select("text", prefix_bpe.encoded(F.col("text"), RANKS, tokenizers.PATTERN).alias("e"))
        for r in columns.select("text", "e", prefix_bpe.decoded(F.col("e"), RANKS, tokenizers.PATTERN).alias("d")).collect():
            assert r["e"] == library.encode_ordinary(r["text"] or "") and bytes(r["d"]) == (r["text"] or "").encode()
    assert prefix_bpe.round_trips(none, RANKS, tokenizers.PATTERN).count() == 0


def test_pairs_fit_when_merging_gives_them_back():
    bpe, rng = prefix_bpe.prefix_bpe(RANKS, tokenizers.PATTERN), random.Random(2)
    short = [i for t, i in bpe.ranks.items() if set(t) <= set(b"ab the  ")]
    pairs = [(a, b) for a in short for b in short] + [(rng.randrange(50_256), rng.randrange(50_256)) for _ in range(3000)]
    for a, b in pairs:
        x, y = bpe.bytes_of[a], bpe.bytes_of[b]
        assert bpe.fits(a, b) == (bpe.merged(x + y) == [x, y])


def test_every_prefix_has_its_last_token(library):
    bpe = prefix_bpe.prefix_bpe(RANKS, tokenizers.PATTERN)
    data = b"internationalisation-unbelievably"
    for end, token in enumerate(bpe.table(data), 1):
        assert bpe.ids(data[:end], bpe.table(data[:end]))[-1] == (bpe.ranks.get(data[:end], token))
        assert b"".join(bpe.bytes_of[i] for i in bpe.ids(data[:end], bpe.table(data[:end]))) == data[:end]


def test_edits_and_appends_equal_a_fresh_encoding(library):
    bpe, rng = prefix_bpe.prefix_bpe(RANKS, tokenizers.PATTERN), random.Random(1)
    letters = "abe 'stre  \n\n\t1290!?.é日😀  LLl"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        table = prefix_bpe.TextTable(bpe, text)
        for _ in range(4):
            at = rng.randint(0, len(text))
            gone, new = rng.randint(0, min(5, len(text) - at)), "".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))
            text = text[:at] + new + text[at + gone:]
            table.replace(at, gone, new)
            assert table.text == text and table.ids() == library.encode_ordinary(text)
        table.append("re 's")
        assert table.ids() == library.encode_ordinary(text + "re 's")
    word = "".join(rng.choice("abcdefghij") for _ in range(3000))  # one match: an edit stops soon behind itself
    table = prefix_bpe.TextTable(bpe, word)
    before = table.work
    table.replace(1000, 3, "zz")
    assert table.ids() == library.encode_ordinary(word[:1000] + "zz" + word[1003:]) and table.work - before < 400
    part = prefix_bpe.PrefixTable(bpe, b"inter")
    part.append(b"national")
    assert part.ids() == library.encode_ordinary("international") and part.work == 13


def test_edits_as_rows(spark, library):
    rows = [(1, "the cat sat", 4, 3, "dog"), (2, "the cat", None, None, "s's"), (3, None, 5, 9, "new"), (4, "abc", -3, -1, None), (5, LONG, 9, 0, "x")]
    edits = spark.createDataFrame(rows, "doc_id long, text string, at int, gone int, new string")
    got = {r["doc_id"]: r for r in prefix_bpe.with_edits(edits, RANKS, tokenizers.PATTERN).collect()}
    want = {1: "the dog sat", 2: "the cats's", 3: "new", 4: "abc", 5: LONG[:9] + "x" + LONG[9:]}
    assert {k: r["ids"] for k, r in got.items()} == {k: library.encode_ordinary(t) for k, t in want.items()}
    assert got[5]["n_prefixes"] < 100


# --- alignment ----------------------------------------------------------------------------

def brute_alignment(rows):
    """Per row (in order) the numbers and groups by walking both token lists, and corpus counts of pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    a_bytes, b_bytes = (t.bytes for t in alignment.both(BPE, tokenizers.PATTERN, PIECES))
    out, counts = [], Counter()
    for _, text in rows:
        x = first.encode(" " + text, add_special_tokens=False).ids if text else []
        y = second.encode(text) if text else []
        want = b" " + (text or "").encode()
        if not text or b"".join(a_bytes[i] for i in x) != want or b"".join(b_bytes[i] for i in y) != want:
            out.append((0, 0, [], []))
            continue
        ends = [[sum(len(s[i]) for i in ids[:k + 1]) for k in range(len(ids))] if len(ids) < 400 else None for ids, s in ((x, a_bytes), (y, b_bytes))]
        if None in ends:
            ends = []
            for ids, s in ((x, a_bytes), (y, b_bytes)):
                at, e = 0, []
                for i in ids:
                    at += len(s[i])
                    e.append(at)
                ends.append(e)
        links, groups, i, j, ga, gb = [], [], 0, 0, [x[0]], [y[0]]
        while True:
            links.append((x[i], y[j]))
            ea, eb = ends[0][i], ends[1][j]
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
            i, j = i + (ea <= eb), j + (eb <= ea)
            if i == len(x):
                break
            if ea <= eb:
                ga.append(x[i])
            if eb <= ea:
                gb.append(y[j])
        counts.update(links)
        out.append((len(x), len(y), groups, links))
    return out, counts


def test_alignment(docs, real, none, spark):
    for df in (docs, real):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        made, counts = brute_alignment(rows)
        most = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        render = lambda groups: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        want = Counter(
            (k, a, b, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), render(g))
            for (k, _), (a, b, g, ls) in zip(rows, made, strict=True))
        aligned = alignment.align(df, BPE, tokenizers.PATTERN, PIECES).withColumn("row", F.monotonically_increasing_id())
        stored = alignment.stored(aligned, spark, "alignment")
        got = alignment.with_corpus_counts(stored, "row")
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        assert Counter(tuple(r[n] for n in names) for r in got.collect()) == want
        table = {r["pair"]: (r["n"], r["best"]) for r in alignment.pair_counts(stored).collect()}
        assert table == {a * alignment.PAIR + b: (n, n == most[b]) for (a, b), n in counts.items()}
    empty = alignment.align(none, BPE, tokenizers.PATTERN, PIECES).withColumn("row", F.monotonically_increasing_id())
    assert alignment.with_corpus_counts(alignment.stored(empty, spark, "alignment"), "row").count() == 0


def test_alignment_in_small_rounds(real, spark, monkeypatch):
    key = lambda df: sorted((r["doc_id"], r["groups"], tuple(r["pairs"]), tuple(r["pair_links"])) for r in df.collect())
    whole = key(alignment.align(real, BPE, tokenizers.PATTERN, PIECES))
    monkeypatch.setattr(alignment, "CHARS", 3000)
    assert key(alignment.align(real, BPE, tokenizers.PATTERN, PIECES)) == whole


# --- manifest -----------------------------------------------------------------------------

def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, i):
    for row in levels[:-1]:
        first = i - i % 3
        yield row[first:i], row[i + 1:first + 3]
        i //= 3


def brute_manifest(rows, tampers):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)))
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda g: g[:3])
        trees[s] = levels_of([g[2] for g in groups[s]])
    top = levels_of([trees[s][-1][0] for s in names])
    for at, s in enumerate(names):
        for i, (_, _, digest, r) in enumerate(groups[s]):
            path = [*siblings(trees[s], i), *siblings(top, at)]
            cur = leaf(r, r["text"].replace("\n", "")) if r["text"] is not None and tampers(r["doc_id"]) else digest
            for left, right in path:
                cur = sha(*left, cur, *right)
            yield (r["doc_id"], digest, trees[s][-1][0], top[-1][0], sha(*(x for p in path for side in p for x in side)), cur, cur == top[-1][0])


def even(key):
    return key is not None and zlib.crc32(str(key).encode()) % 2 == 0


def is_even():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0


@pytest.mark.parametrize("levels", [1, 2, manifest.LEVELS])
def test_manifest(docs, real, none, levels):
    for df in (docs, real):
        got = Counter(tuple(r) for r in manifest.verified(df, tampered=is_even(), levels=levels).collect())
        assert got == Counter(brute_manifest(df.collect(), even))
    if levels == manifest.LEVELS:
        assert manifest.verified(none, tampered=is_even()).count() == 0
        assert all(r["verified"] for r in manifest.verified(docs).collect())


def test_manifest_query_finds_what_was_tampered_with(spark, real):
    got = {r["doc_id"]: r["verified"] for r in queries.QUERIES["op13_merkle_manifest"](spark, SF).collect()}
    assert got == {r["doc_id"]: not (even(r["doc_id"]) and "\n" in (r["text"] or "")) for r in real.collect()}


@pytest.mark.parametrize("n", [*range(1, 30), 80, 81, 82, 243, 250])
def test_postorder_places(n):
    """Places in closed form against a log that is written by recursion."""
    height = manifest.height_of(n, n, manifest.LEVELS)
    order = []

    def walk(level, index):
        if level:
            for c in range(3 * index, min(3 * index + 3, -(-n // 3 ** (level - 1)))):
                walk(level - 1, c)
        order.append((level, index))

    walk(height, 0)
    assert [manifest.complete(level, i, n, height) for level, i in order] == list(range(len(order)))
    for level in range(height + 1):
        assert manifest.places(level, n, height).tolist() == [manifest.complete(level, i, n, height) for i in range(-(-n // 3**level))]
    leaves = [sha(str(i)) for i in range(n)]
    log = manifest.append_log(leaves, height)
    assert len(log) == len(order) and log[-1] == levels_of(leaves)[-1][0]


def test_log_as_a_table(real, spark):
    rows = manifest.leaves_of(real, "doc_id", "source", ("doc_id", "text"), None, None)
    made = manifest.manifest(rows, spark, levels=2)
    nodes = manifest.nodes(made.groups)
    assert nodes.where("length(digest) <> 64").count() == 0
    leaves = {r["leaf"] for r in rows.collect()}
    assert leaves <= {r["digest"] for r in nodes.where("stage = 0").collect()}
