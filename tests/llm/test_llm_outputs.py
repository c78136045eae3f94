"""Token files, Merkle manifest and hard negatives against plain rules, and on odd rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import SF, given
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gateflow.llm import merkle, multi_index, simple8b, token_files
from gateflow.llm.queries import QUERIES
from gateflow.sinks.tables import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CLASH = ("id", "row", "tie", "part", "file", "before", "tree", "index", "n", "digest", "other", "way", "root", "v", "window", "query", "cell", "score")
LONG = " ".join(f"word{i % 97}, Don't" for i in range(40_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "Same text"), (5, "Same text"), (5, "Same text"), (5, "other"), (None, "No id"), (None, None),
    (-7, "negative é"), (9, LONG), (10, "w" * 60_000), (11, "<|endoftext|> x<|endoftext|>y"), (12, "😀 ’s 's don't K"), (2**62, "big id"),
]


def docs(spark, rows, extra=()):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *extra]
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in CLASH])
    return spark.createDataFrame([(*r, *("x" for _ in CLASH)) for r in rows], schema)


# --- Simple-8b and token files


def test_simple8b_round_trip():
    pick = np.random.default_rng(1)
    for k in range(60):
        lengths = pick.integers(0, 700, pick.integers(0, 8))
        n = int(lengths.sum())
        bits = pick.integers(0, 65, n) if k % 3 else pick.integers(0, 4, n)
        values = np.array([int(pick.integers(0, 2**62)) * 4 + 3 >> 64 - int(b) if b else 0 for b in bits], np.uint64)
        words, first = simple8b.pack(values, lengths)
        assert (simple8b.unpack(words, first, lengths) == values).all()


def test_simple8b_words_are_as_full_as_the_selectors_allow():
    pack = lambda values: simple8b.pack(np.array(values, np.uint64), np.array([len(values)]))[0].tolist()
    assert pack([1, 0, 1]) == [2 << 60 | 0b101]  # 60 values of a bit
    assert pack([0] * 120) == [1 << 60]
    assert pack([2**20 - 1, 5, 7]) == [13 << 60 | 7 << 40 | 5 << 20 | 2**20 - 1]
    assert pack([2**60 - 1]) == [15 << 60 | 2**60 - 1]
    assert pack([2**60, 3]) == [1, 2**60, 12 << 60 | 3] or pack([2**60, 3])[:2] == [1, 2**60]  # an escape, then the value
    words, first = simple8b.pack(np.full(700, 2**63, np.uint64), np.array([300, 0, 400]))
    assert len(words) == 1400 and first.tolist() == [0, 512, 600, 1112]


def test_word_coder_equals_the_tokenizer():
    plain = Tokenizer.from_file(VOCABULARY)
    pieces = ["don't", "DON'T", "'s", "'Sabc", "a.b", ".", ",", "...", "é", "É", "J̌", " ́", "<|endoftext|>", "<|ENDOFTEXT|>", "123", "１２",
              " ", "\x1c", "\x85", "ΑΣ", "日本語", "한국", "a,'s", "x)y", "A;́b", "İ", "ǅ", "ﬁ", "\n", " ", "w" * 300, "😀", "ſ", "K", "'re", "!",
              "x$$", "é.", "É-", "×.", "÷,", "ñ'", "a|", "b>", "c<", "|>", "<|", "é\u0301.", "a\u0301,", "_", "a=b", "#x", "ß%", "ÿ/", "'", "''s", "-'s"]
    pick = random.Random(3)
    texts = ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 12))) for _ in range(3000)]
    coder = token_files.WordCoder(open(VOCABULARY, encoding="utf-8").read())
    want = plain.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):  # words new and known
        ids, n = coder(pa.array(texts))
        assert n.tolist() == [len(c.ids) for c in want] and ids.tolist() == [i for c in want for i in c.ids]


def coded(text):
    return [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FRAMES_A_FILE", 1)
    monkeypatch.setattr(token_files, "FRAME_IDS", 8)
    monkeypatch.setattr(token_files, "SLICE", 40)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs(spark, ODD), path, VOCABULARY, end_id=2)
    back = token_files.read_tokens(spark, path)
    got = sorted((repr(r["doc_id"]), struct.unpack(f"<{r['n_tokens']}I", r["ids"])) for r in back.collect())
    assert got == sorted((repr(i), tuple(coded(t))) for i, t in ODD)
    index = sorted(token_files.token_index(back).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in index] == np.append(0, np.cumsum([r["n_tokens"] for r in index]))[:-1].tolist()
    ids = [r["doc_id"] for r in index]
    assert ids == sorted((i for i in ids if i is not None)) + [None, None]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    assert files.count() > 2 and files.where("length % 8 <> 0").isEmpty()
    # the row number parts equal rows, the digest of the text orders rows of one id
    again = sorted(token_files.token_index(back).collect(), key=lambda r: r["start"])
    assert [tuple(r) for r in again] == [tuple(r) for r in index]


def test_token_files_of_an_empty_table_and_damage(spark):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs(spark, []), path, VOCABULARY, end_id=2)
    assert token_files.token_index(token_files.read_tokens(spark, path)).collect() == []
    whole = token_files.frame([1, None], np.array([3, 0]), np.array([7, 8, 9], np.uint64)) + token_files.END.encode()
    ((own, lengths, ids),) = token_files.frames(memoryview(whole))
    assert (own, lengths.tolist(), ids.tolist()) == ([1, None], [3, 0], [7, 8, 9])
    broken = whole[:40] + bytes([whole[40] ^ 1]) + whole[41:]
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.frames(memoryview(broken)))


def test_token_query_equals_brute_force(spark):
    at, want = 0, []
    for d in sorted(given("documents"), key=lambda d: d["doc_id"]):
        ids = coded(d["text"])
        want.append((d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = QUERIES["op11_token_output"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == want


# --- Merkle manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes):
    """(root, siblings on the left and right of each node's ancestors)."""
    ways, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            run = at // 16 * 16
            ways[k] += ["".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])]
            places[k] = at // 16
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], ways


def plain_manifest(rows):
    """Of (doc_id, text, source): the manifest's rows."""
    leaf = lambda i, s, t: sha(field(i) + field(s) + field(t))
    low = lambda t: t if t is None else t.translate({c: c + 32 for c in range(65, 91)})
    own = {}
    for i, t, s in rows:
        own.setdefault(s, []).append((i is not None, i or 0, leaf(i, s, t), i, t))
    sources = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([x[2] for x in sorted(own[s], key=lambda x: x[:3])]) for s in sources}
    root, tops = climbed([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (_, _, h, i, t), way in zip(sorted(own[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            way = way + top
            folded = leaf(i, s, low(t)) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else h
            for left, right in zip(way[::2], way[1::2], strict=True):
                folded = sha(left + folded + right)
            out.append((i, h, trees[s][0], root, sha("".join(way)), folded, folded == root, max(1, len(way) // 2)))
    return out


def manifest_of(spark, rows):
    frame = docs(spark, rows, [T.StructField("source", T.StringType())])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = {"text": F.translate("text", upper, upper.lower())}
    return merkle.manifest(frame, ["doc_id", "source", "text"], F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(15, "One", "a")],
        [(15, "Same", None), (15, "Same", None), (None, None, None), (None, "X", "é"), (3, "", ""), *((i, t, "s") for i, t in ODD)],
        [(i, f"Text {i}", "hot") for i in range(700)] + [(i, "T", f"s{i}") for i in range(20)] + [(i, "Same", "copies") for i in [5] * 300],
    ],
    ids=["empty", "one leaf", "odd", "large source"],
)
def test_manifest_equals_plain_rules(spark, rows):
    got = [tuple(r) for r in manifest_of(spark, rows).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)


def test_versions_share_all_but_ancestors(spark):
    leaves = [sha(str(i)).encode() for i in range(200)]
    block = merkle.Block(leaves, 200)
    changed = merkle.version(b"new", block.siblings(77))
    again = merkle.Block([*leaves[:77], b"new", *leaves[78:]], 200)
    assert changed == [again.levels[1][77 // 16], again.levels[2][0]]
    shared = [a == b for x, y in zip(block.levels[1:], again.levels[1:], strict=True) for a, b in zip(x, y, strict=True)]
    assert shared.count(False) == len(changed)


def test_nodes_of_a_tree(spark):
    rows = spark.createDataFrame([("a", i, sha(str(i))) for i in range(300)] + [("b", 1, sha("x"))], "tree string, id long, digest string")
    tree = merkle.Tree(merkle.placed(rows, "tree", ["id"]))
    nodes = {(r["tree"], r["level"], r["index"]): r["digest"] for r in tree.nodes().collect()}
    assert len(nodes) == 19 + 2 + 1
    assert nodes["a", 1, 18] == sha("".join(sha(str(i)) for i in range(288, 300)))
    assert {r["tree"]: r["root"] for r in tree.roots().collect()} == {"a": nodes["a", 3, 0], "b": sha("x")}


# --- hard negatives


def vectors(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in CLASH])
    return spark.createDataFrame([(*r, *("x" for _ in CLASH)) for r in rows], schema)


def plain_negatives(rows, anchor=lambda i: i % 4 == 0, k=5, m=10):
    """Of (vec_id, vector, label): the rows of hard_negatives, by number of the row."""
    usable = [(i, v, lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for _, v, _ in usable]
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=False))
    order = lambda s: sorted(s, key=lambda p: (-p[0], p[1] is None, p[1] or 0))
    out = []
    for a, (i, _, lab) in enumerate(usable):
        if i is None or not anchor(i):
            continue
        told = [(score(a, b), j, other == lab) for b, (j, _, other) in enumerate(usable) if b != a]
        for p, j, _ in order(t for t in told if t[2])[:k]:
            fit = order((s, x) for s, x, same in told if not same and 30 * p <= 100 * s <= 90 * p)[:m]
            out += [(i, j, r + 1, x, p, s) for r, (s, x) in enumerate(fit)]
    return out


def mined(frame):
    return multi_index.hard_negatives(frame, F.col("id") % 4 == 0, F.col("label"))


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    pick = np.random.default_rng(4)
    centres = pick.normal(0, 0.2, (6, 7))
    rows = [(i, (centres[i % 6] + pick.normal(0, 0.1, 7)).astype(np.float32).tolist(), int(pick.integers(0, 4))) for i in range(600)]
    rows += [(1000 + i, rows[0][1], 3) for i in range(300)]  # a group of equal vectors
    monkeypatch.setattr(multi_index, "CELL_ROWS", 4)
    monkeypatch.setattr(multi_index, "FIRST_ROWS", 20)
    monkeypatch.setattr(multi_index, "SHELF_ROWS", 50)
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 32)
    got = [tuple(r) for r in mined(vectors(spark, rows)).collect()]
    assert sorted(got) == sorted(plain_negatives(rows)) and len(got) > 1000


def test_the_driver_gets_a_bounded_part_of_the_index(spark, monkeypatch):
    rows = spark.range(0, 4000, 1, 40).select(
        F.col("id").alias("row"), "id", (F.col("id") % 3).alias("label"), F.array(*[F.col("id") * k % 11 for k in (1, 3, 5, 7)]).alias("v")
    )
    monkeypatch.setattr(multi_index, "SAMPLE", 100)
    index = multi_index.MultiIndex(rows)
    digest = F.xxhash64("row")
    want = [r["v"] for r in index.rows.orderBy(digest, "row").limit(100).collect()]
    assert [r["v"] for r in index._sample().collect()] == want
    # of the rows most are left out before tasks send the driver theirs to choose from
    assert re.search(r"Filter .*xxhash64\(row", index._sample()._jdf.queryExecution().optimizedPlan().toString())
    # queries with the shelves they visit are small in files and large in memory
    asks = index.rows.select("row", "label", "v", F.array(F.lit(multi_index.LEAST)).alias("low"), F.array(F.lit(multi_index.MOST)).alias("high"))
    plan = index._scored(asks, 16, 1, 5, True, True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_hard_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [0.5, 0.5, 0.1], 1), (0, [0.5, 0.5, 0.1], 1), (4, [0.5, 0.4], 1), (5, [0.4, 0.3, 0.2], 2), (5, [0.4, 0.3, 0.2], 2),
        (None, [0.5, 0.5, 0.1], 1), (None, [0.4, 0.3], 2), (8, None, 1), (12, [0.1, None], 1), (16, [nan, 0.1], 1), (20, [inf], 2),
        (24, [0.3, 0.3, 0.3], None), (28, [], 1), (32, [0.0, 0.0, 0.0], 2), (36, [-0.5, -0.5, 0.0], 2), (40, [-0.001, 0.2, 0.3], 3),
    ]
    got = [tuple(r) for r in mined(vectors(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain_negatives(rows), key=repr) and got
    assert mined(vectors(spark, [])).collect() == []
    assert mined(vectors(spark, [(8, None, 1), (4, [], None)])).collect() == []


def test_scores_beyond_floating_point_are_exact(spark):
    rows = [(i, [float(2**20 + i), 1.0 + i, -3.0], i % 2) for i in range(12)]
    got = [tuple(r) for r in mined(vectors(spark, rows)).collect()]
    assert sorted(got) == sorted(plain_negatives(rows))
    near = [(i, [float(2**20), i / 256, 0.0], 0) for i in range(9)] + [(9 + i, [0.5 * 2**20, i / 256, 0.0], 1) for i in range(9)]
    assert sorted(tuple(r) for r in mined(vectors(spark, near)).collect()) == sorted(plain_negatives(near))


def test_second_wave_stops_early(spark):
    """With well parted groups most cells are never visited."""
    pick = np.random.default_rng(6)
    points = np.repeat(np.eye(16) * 400, 40, axis=0) + pick.integers(-3, 4, (640, 16))
    index = multi_index.Cells((np.eye(8), np.eye(8)), np.zeros((8, 8), np.int64), (np.zeros((8, 8)), np.zeros((8, 8))))
    words = tuple(multi_index.codebook(p, 9) for p in (points[:, :8], points[:, 8:]))
    own = [multi_index.nearest_word(p, w) for p, w in zip((points[:, :8], points[:, 8:]), words, strict=True)]
    far = [multi_index.distances(p, w, o) for p, w, o in zip((points[:, :8], points[:, 8:]), words, own, strict=True)]
    shape = tuple(len(w) for w in words)
    index = multi_index.Cells(words, np.zeros(shape, np.int64), (np.zeros(shape), np.zeros(shape)))
    np.add.at(index.counts, tuple(own), 1)
    for radius, f in zip(index.radii, far, strict=True):
        np.maximum.at(radius, tuple(own), f)
    query = points[:1]
    (cells,) = index.visits(query, np.array([100_000.0]), np.array([1e18]))
    seen = {divmod(c, shape[1]) for c in cells}
    (first,) = index.visits(query, None, None)
    missed = [i for i, p in enumerate(points) if p @ query[0] >= 100_000 and (own[0][i], own[1][i]) not in seen | {divmod(c, shape[1]) for c in first}]
    assert not missed and len(cells) < (index.counts > 0).sum()
