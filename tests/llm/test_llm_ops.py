"""Operators on rows that are null, empty, long, tied or repeated, on empty tables
and on tables whose other columns have clashing names."""

import random
import re
import string

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from brute import SF, alnum, given, leaks, near, personal, sha, spaced
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from gateflow.llm import bpe, decontaminate, exact_dedup, language_id, license_scan, ngram_join, pii, quality, text_stats, toxicity, warc, words
from gateflow.llm.oracle import ORACLE
from gateflow.llm.queries import QUERIES
from gateflow.sinks.tables import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ("id", "row", "sid", "n", "bits", "label", "key", "words", "chars", "digest", "keep_id", "spans", "kept", "text_sha256")
WORDS = [w for d in given("documents")[:8] for w in d["text"].split()[:60]]


def prose(n: int, seed: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    def frame(rows):
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
        schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in CLASH])
        return spark.createDataFrame([(i, t, "en", *(["x", None][k % 2] for k, _ in enumerate(CLASH))) for i, t in rows], schema)

    return frame


BODY = prose(80, 1)
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, BODY), (5, BODY), (5, BODY), (None, BODY), (6, BODY.replace(" ", "\n ", 3)),
    (7, prose(3, 2)), (8, prose(3, 2).upper()), (9, BODY + " more"), (10, prose(9_000, 3)), (None, None), (11, "word"),
    (12, "w" * 60_000), (13, prose(300, 4)), (14, prose(299, 4) + " other"),
]


def of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def low(ids):
    return min((i for i in ids if i is not None), default=None)


# --- personal data


def test_pii_matches_plain_rules(docs):
    pieces = ["a.b@c.d.e", "x@y", "1.2.3.4", "1.2.3.256", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (234) 555-7890", "+12", "--",
              "a@b.c_d@e.f", "é@é.fr", "0007.1.1.1", "4111-1111-1111-1111-1", "😀", " ", "\n", ".", "@", "+", "1234567890123456789", "12 34 5"]
    pick = random.Random(7)
    rows = [(i, "".join(pick.choice(pieces) + pick.choice(["", " ", "-"]) for _ in range(pick.randint(1, 12)))) for i in range(120)]
    rows += [(500, "9" * 5_000 + "@" * 300 + "a." * 3_000), (501, "1 2 " * 4_000), (502, "a@b" + ".c" * 3_000), *ODD]
    got = of(pii.personal_data(docs(rows)), "doc_id", *pii.KINDS)
    want = [(i, *([(s, e) for k, s, e in personal(t) if k == kind] for kind in pii.KINDS)) for i, t in rows]
    assert got == sorted([(r[0], *([tuple(s) for s in x] for x in r[1:])) for r in want], key=repr) or [
        (r[0], *([tuple(s) for s in x] for x in r[1:])) for r in got
    ] == sorted(want, key=repr)


def test_many_matches_in_one_text(docs):
    text = " ".join(f"u{i}@h.org" for i in range(2_500))
    (row,) = pii.personal_data(docs([(1, text)])).collect()
    assert [tuple(s) for s in row["email"]] == [(s, e) for _, s, e in personal(text)]


def test_trusted_contexts_mark_unseen_identifiers(docs):
    mails = [(i, f"{prose(5, i)} write me at user{i}@mail.org now") for i in range(6)]
    unseen = [(50, f"{prose(5, 50)} write me at user50(at)mail today"), (51, "version is 2.0.1 here, about 12345 of them")]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(mails + unseen)).collect()}
    text = unseen[0][1]
    start = text.index("user50")
    assert [tuple(s) for s in got[50]["context"]] == [(start, start + len("user50(at)mail"))]
    assert got[51]["context"] == [] and all(got[i]["context"] == [] for i in range(6))


def test_contexts_reach_across_tokens_and_whole_base_matches(docs):
    rows = [(i, f"{prose(5, i)} my number: +1 ({743 + i}) 555-38{24 + i} and ticket {17 + i}: <user{i}@mail.org> end") for i in range(6)]
    unseen = [(50, f"{prose(5, 50)} my number: 743.555.9999 ok"), (51, f"{prose(5, 51)} TICKET 98:  user50(at)mail, 4 12 34567"), (52, "number: 743.555.9998")]
    long = "w" * 100
    rows += [(20 + i, f"{long} {long} q{i}@r.org") for i in range(6)] + [(60, f"{long} {long} q(at)r12")]
    got = {r["doc_id"]: [tuple(s) for s in r["context"]] for r in pii.personal_data(docs(rows + unseen)).collect()}
    for i, text, found in ((50, unseen[0][1], "743.555.9999"), (51, unseen[1][1], "user50(at)mail"), (60, rows[-1][1], "q(at)r12")):
        at = text.index(found)
        assert got[i] == [(at, at + len(found))]
    assert not any(x for i, x in got.items() if i not in (50, 51, 60))


def test_instances_of_odd_texts_match_plain_rules(docs):
    import re

    pick = random.Random(8)
    pieces = ["a.b@c.de", "x@y", "1.2.3.4", "4111 1111 1111 1111", "+1 (234) 555-7890", "(743)", "word", "Other", "12345,", "7", "😀", "(",
              '"a1b2c3d4e5f6a7b8"', "<0a0b0c0d0e0f0g0h>!!", "a1b2c3d4 e5f6", "[abcdef123456789abcdef]", "#" ]
    rows = [(i, "".join(pick.choice(pieces) + pick.choice(["", " ", "  ", "\n"]) for _ in range(pick.randint(1, 25)))) for i in range(60)]

    def plain(text):
        words = list(re.finditer(r"[^ \n]+", text))
        before = lambda at: " ".join(w[0] for w in [w for w in words if w.end() <= at][-2:])
        pattern = lambda at: re.sub("[1-9]", "0", before(at).lower()) if " " in before(at) else None
        base, out = personal(text), []
        for _, s, e in base:
            out.append((s, e, text[s:e], pattern(max(w.start() for w in words if w.start() <= s)), True, True))
        for w in words:
            opened = w[0].lstrip("\"'`(<[{")
            told = opened.rstrip("\"'`)>]}.,;:!?#*%$")
            s = w.end() - len(opened)
            e = s + len(told)
            turns = len(re.findall("[0-9]+[A-Za-z+/_=-]+", told))
            secret = bool(16 <= len(told) <= 512 and re.fullmatch("[A-Za-z0-9+/_=-]+", told) and turns >= 4)
            if re.search("[0-9@]", w[0]) and len(told) >= 5 and not any(a < e and s < b for _, a, b in base):
                out.append((s, e, told, pattern(w.start()), secret, False))
        return sorted(out, key=repr)

    cut = [pii.base_matches(F.col("text"), k).alias(k) for k in pii.KINDS]
    read = docs(rows).select("doc_id", *cut, pii.tokens(F.col("text")).alias("token")).select("doc_id", pii.instances().alias("t"))
    got = {r["doc_id"]: sorted((tuple(t) for t in r["t"]), key=repr) for r in read.collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_secrets_teach_their_context(docs, spark):
    """A trusted context marks what stands in it, also what has another shape."""
    pick = random.Random(11)
    hexes = ["".join(pick.choice("0123456789abcdef") for _ in range(40)) for _ in range(12)]
    rows = [(100 + i, f'{prose(6, i)} token = "{h}" {prose(6, 100 + i)}') for i, h in enumerate(hexes)]
    other = [(50, f'{prose(6, 50)} token = "swordfish1" {prose(4, 1)}'), (51, f"{prose(6, 51)} commit 12 {hexes[0][::-1]} here"), (52, f"{prose(5, 2)} token is 12345 now")]
    got = {r["doc_id"]: [tuple(x) for x in r["context"]] for r in pii.personal_data(docs(rows + other + ODD)).collect() if r["doc_id"] is not None}
    for i, (_, text) in enumerate(rows):
        at = text.index(hexes[i])
        assert got[100 + i] == [(at, at + 40)]
    at = other[0][1].index("swordfish1")
    assert got[50] == [(at, at + 10)] and got[51] == [] and got[52] == []


def test_planted_secrets_of_the_documents_are_found(spark):
    import re

    got = {r["doc_id"]: r for r in QUERIES["op1_pii"](spark, SF.replace("sf0.001", "sf0.01")).collect()}
    import pyarrow.parquet as pq

    held = 0
    for d in pq.read_table(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").to_pylist():
        secrets = [m.span(1) for m in re.finditer(r'token = "([0-9a-f]+)"', d["text"] or "")]
        held += bool(secrets)
        told = got[d["doc_id"]]["spans"].split(",")
        assert [f"context:{a}:{b}" in told for a, b in secrets] == [True] * len(secrets)
        assert got[d["doc_id"]]["n_context"] == len(secrets)  # and nothing else is marked
    assert held > 5


def test_pii_has_no_python_on_the_executors(spark):
    from conftest import plan_of

    assert not any(x in plan_of(QUERIES["op1_pii"](spark, SF)) for x in ("Python", "Pandas", "Arrow"))


# --- quality and toxicity


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op2_quality"](spark, sf).join(labels, "doc_id").where("held_out")
    right = [(r["predicted"] == r["quality"]) for r in got.collect()]
    assert len(right) > 50 and sum(right) / len(right) > 0.93


def test_quality_of_odd_rows(docs, spark):
    told = spark.createDataFrame([(4, 1, 0), (5, None, None), (7, 1, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (told, told.limit(0)):
        got = of(quality.quality_scores(docs(ODD), labels, F.lit(True)), "doc_id", "score")
        assert len(got) == len(ODD) and all(0 <= s <= 1 for _, s in got)
    kept = quality.of_quality(docs(ODD), told, F.lit(True), 0.3)
    assert kept.columns == docs(ODD).columns and kept.count() == len(ODD)
    assert quality.quality_scores(docs([]), told, F.lit(True)).count() == 0


def test_rules_are_paths_with_tight_bounds(spark):
    rule = frozenset({("signs", True, 0.5), ("signs", False, 0.1)})
    ensemble = quality.RuleEnsemble(-1.0, {rule: 2.0})
    df = spark.createDataFrame([(0.3,), (0.05,), (0.7,)], "signs double").select("signs", ensemble.score().alias("s"))
    assert [round(r["s"], 4) for r in df.collect()] == [0.7311, 0.2689, 0.2689]


def test_toxicity_finds_planted_words(docs, spark):
    rows = [(i, prose(40, i) + (" Zork! " if i % 5 == 0 else " ") + prose(20, i + 999)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0), int(i % 10 == 0)) for i in range(150)] + [(151, None, 0), (None, 1, 1)], "doc_id long, toxic int, worse int")
    categories = {"toxic": F.col("toxic"), "worse": F.col("worse")}
    got = toxicity.toxicity(docs(rows), labels, categories).collect()
    assert {r["doc_id"] for r in got if r["flagged"]} == set(range(0, 200, 5))
    assert all(0 <= r["p_worse"] <= 1 for r in got)
    odd = toxicity.toxicity(docs(ODD), labels.limit(0), categories)
    assert of(odd, "doc_id", "flagged") == sorted([(i, False) for i, _ in ODD], key=repr)
    assert toxicity.toxicity(docs([]), labels, categories).count() == 0


def test_the_sample_for_toxicity_is_bounded(docs, spark, monkeypatch):
    """Ids that repeat among documents and labels are one row of the sample."""
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, columns, labels, fold: seen.append((rows, columns, labels)) or [])
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 2)
    rows = [(1, f"word{i} same") for i in range(50)] + [(2, "b c d"), (3, "e"), (None, "x")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1), (3, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    learn = lambda: toxicity.learn(docs(rows), labels, {"toxic": F.col("toxic")}, "doc_id", "text")
    learn()
    assert len(seen[0][2]) == 2 and set(seen[0][0].tolist()) == {0, 1}
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 10)
    learn()
    assert seen[1][2].tolist() == [[0.0], [1.0], [1.0]]  # of several labels the smallest, null ones left out
    assert [int((seen[1][0] == k).sum()) for k in range(3)] == [2, 3, 1]
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 3)
    learn()
    assert len(seen[2][1]) <= 3


def test_chain_equals_plain_arithmetic(docs, spark):
    """Scores follow from the models' weights as written: words, then earlier probabilities."""
    import math

    pick = random.Random(2)
    rows = [(i, " ".join(pick.choice(["bad", "vile", "good", "fine", "calm", "blue"][i % 2 :: 2]) for _ in range(6))) for i in range(80)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 4 // 2) for i in range(80)], "doc_id long, toxic int, second int")
    categories = {"toxic": F.col("toxic"), "second": F.col("second")}
    chain = toxicity.learn(docs(rows), labels, categories, "doc_id", "text")
    words = {i: next(toxicity.hashed_words(pa.array([t]))).tolist() for i, t in rows}
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(rows), labels, categories).collect()}
    for i, _ in rows:
        earlier = []
        for model in chain:
            weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
            z = model.intercept + sum(weight.get(w, 0.0) for w in words[i]) + sum(a * b for a, b in zip(model.earlier.tolist(), earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-z)))
        assert abs(got[i]["p_toxic"] - earlier[0]) < 1e-9 and abs(got[i]["p_second"] - earlier[1]) < 1e-9
        assert got[i]["flagged"] == (i % 2 == 0)


def plain_stats(text: str) -> dict:
    import math
    import re
    from itertools import pairwise

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    text = text or ""
    share = lambda a, b: a / b if b else 0.0
    count = lambda p: len(re.findall(p, text))
    letters, wide = count(r"[A-Za-z]") + count(r"[^\x00-\x7f]"), count(r"[^\x00-\x7f]")
    blank = count(r"[\x20\x09-\x0D]")
    return {
        "chars": math.log1p(len(text)), "words": math.log1p(len(words)), "word_length": share(len(text) - blank, len(words)),
        "letters": share(letters, len(text)), "upper": share(count("[A-Z]"), letters), "digits": share(count("[0-9]"), len(text)),
        "signs": share(len(text) - letters - count("[0-9]") - blank, len(text)), "lines": share(count("\n"), len(words)),
        "wide": share(wide, letters), "distinct": share(len(set(words)), len(words)),
        "repeated": share(sum(a == b for a, b in pairwise(words)), len(words)),
        "top_word": share(max(map(words.count, set(words)), default=0), len(words)),
    }


def test_statistics_equal_plain_counting(docs, spark):
    texts = [t for _, t in ODD] + ["", "Ü ü É\n\nxX 12 12 !?", "\x00\x7f a", "日本 語", "a " * 50, None]
    table = text_stats.text_stats(pa.array(texts, pa.string()))
    for row, t in zip(table, texts, strict=True):
        want = plain_stats(t)
        assert [round(x, 9) for x in row] == [round(want[s], 9) for s in text_stats.STATS], t
    rows = text_stats.beside(docs(list(enumerate(texts))), "text")
    got = {r["row"]["doc_id"]: r for r in rows.collect()}
    assert all(abs(got[i][s] - plain_stats(t)[s]) < 1e-9 for i, t in enumerate(texts) for s in text_stats.STATS)
    assert got[0]["row"].asDict()["digest"] in ("x", None)
    assert text_stats.text_stats(pa.array([], pa.string())).shape == (0, len(text_stats.STATS))


def test_words_of_a_long_text_in_pieces(monkeypatch):
    text = pa.array([" ".join(f"Wörd{i % 977} {'x' * (i % 40)}" for i in range(900)) + "y" * 900 + "  "])
    whole = words.word_digests(text, words.SPACED)
    monkeypatch.setattr(words, "SLICE_BYTES", 128)
    apart = words.word_digests(text, words.SPACED)
    assert apart.counts.tolist() == whole.counts.tolist() and apart.digests.tolist() == whole.digests.tolist()


def test_scores_equal_the_rules_by_hand(spark):
    """The compiled column is the logistic of the weights of the rules that hold."""
    import math

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = text_stats.with_stats(docs, "doc_id", "text")
    ensemble = quality.learn(stats, labels, F.lit(True))
    assert ensemble.weights
    got = {r["id"]: r["score"] for r in stats.select("id", ensemble.score().alias("score")).collect()}
    for d in given("documents"):
        own = plain_stats(d["text"])
        held = [w for rule, w in ensemble.weights.items() if all(own[s] <= v if upper else own[s] > v for s, upper, v in rule)]
        assert abs(got[d["doc_id"]] - 1 / (1 + math.exp(-ensemble.intercept - sum(held)))) < 1e-9


def test_toxicity_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r for r in got if r["toxic"] == 0]
    assert sum(r["flagged"] for r in clean) <= 0.02 * len(clean)


# --- exact dedup


def normal(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_of_odd_rows(docs, spark):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "idx"), 4)
    got = of(exact_dedup.deduplicate(docs(ODD), index), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = {}
    for i, t in ODD:
        groups.setdefault(normal(t), []).append(i)
    want = [(i, low(groups[normal(t)]), len(groups[normal(t)]), i == low(groups[normal(t)]), sha(normal(t))) for i, t in ODD]
    assert got == sorted(want, key=repr)
    assert exact_dedup.deduplicate(docs([]), index).count() == 0


def test_indexes_in_folders_of_one_name_are_apart(docs, spark):
    root = scratch_path(spark, "indexes")
    once = lambda path, rows: of(exact_dedup.deduplicate(docs(rows), exact_dedup.DigestIndex(spark, path, 4)), "doc_id", "keep_id", "kept")
    assert once(f"{root}/a/index", [(1, "x")]) == [(1, 1, True)]
    assert once(f"{root}/b/index", [(7, "x")]) == [(7, 7, True)]
    assert once(f"{root}/c/", [(8, "x")]) == [(8, 8, True)] and once(f"{root}/d/", [(9, "x")]) == [(9, 9, True)]
    # with a slash or without it is the same folder, and a later index finds what is there
    assert once(f"{root}/c", [(10, "x"), (11, "y")]) == [(10, 8, False), (11, 11, True)]


def test_an_index_keeps_its_number_of_buckets(docs, spark):
    path = scratch_path(spark, "index")
    texts = [(i, f"text {i}") for i in range(40)]
    exact_dedup.deduplicate(docs(texts), exact_dedup.DigestIndex(spark, path, 4)).collect()
    other = spark.newSession()
    with pytest.raises(ValueError, match="has 4 buckets, not 8"):
        exact_dedup.DigestIndex(other, path, 8)
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert exact_dedup.deduplicate(docs(texts), again).where("keep_id <> doc_id").isEmpty()
    assert again.table().count() == 40
    bare = scratch_path(spark, "bare")
    spark.range(3).selectExpr("cast('a' as binary) as digest", "id as keep_id").write.parquet(bare)
    with pytest.raises(ValueError, match="not the number of its buckets"):
        exact_dedup.DigestIndex(spark, bare, 4)


def test_index_outlives_the_batch(docs, spark):
    from conftest import plan_of

    path = scratch_path(spark, "idx")
    index = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.deduplicate(docs([(5, "a b"), (6, "c")]), index).collect()
    again = exact_dedup.DigestIndex(spark, path, 4)
    got = of(exact_dedup.deduplicate(docs([(1, "a  b"), (7, "d"), (8, "d")]), again), "doc_id", "keep_id", "kept")
    assert got == [(1, 5, False), (7, 7, True), (8, 7, False)]
    assert again.table().count() == 3
    groups = spark.createDataFrame([(bytes(32), 1)], "digest binary, keep_id long")
    plan = plan_of(again.unseen(groups))
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1


# --- WARC


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, bytes int")


def test_warc_round_trip(spark):
    big = "<p>" + prose(60, 1) + "é</p>"
    rows = [(i, f"http://h/{i}", f"<html>{prose(30 + i % 7, i)}</html>") for i in range(60)]
    rows += [(100, "http://a b\r\nX: y", big), (101, None, big), (99, "u", big), (102, "u", "tiny"), (103, "u", "tiny"), (104, "u", None), (105, "u", ""), (None, "u", big)]
    path = scratch_path(spark, "warc")
    warc.write_warc(pages(spark, rows), path, archive_bytes=4_000)
    records = warc.read_warc(spark, path).collect()
    bodies = {r["page_id"]: r["payload"].decode() for r in records if r["record_type"] == "response"}
    assert bodies == {i: h or "" for i, _, h in rows if i not in (100, 101, None)}
    assert {r["page_id"]: r["refers_to"] for r in records if r["record_type"] == "revisit"} == {100: 99, 101: 99, None: 99}
    assert next(r["url"] for r in records if r["page_id"] == 100) == "http://a%20b%0D%0AX:%20y"
    got = of(warc.payload_index(warc.read_warc(spark, path)), "page_id", "payload_bytes", "payload_digest")
    assert got == sorted([(i, len((h or "").encode()), sha(h or "")) for i, _, h in rows], key=repr)


def test_archive_leads_with_its_dictionary():
    import struct

    records = [warc.record(i, "u", prose(80, i).encode(), "0", None, "d") for i in range(200)]
    body = warc.archive(records) + b"\n"
    assert struct.unpack_from("<I", body)[0] == warc.DICTIONARY_MAGIC
    assert list(warc.frames(body)) == records and list(warc.frames(body + body)) == records * 2
    assert len(body) < len(warc.archive(records[:1])) * 200
    assert list(warc.frames(warc.archive([b"one"]) + b"\n")) == [b"one"]


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    warc.write_warc(pages(spark, []), path)
    assert warc.payload_index(warc.read_warc(spark, path)).count() == 0


# --- tokens


def test_tree_concatenation_equals_the_tokenizer():
    ours, theirs = bpe.Vocabulary(open(VOCABULARY).read()), Tokenizer.from_file(VOCABULARY)
    pick = random.Random(4)
    parts = [
        lambda n: "a" * n, lambda n: " " * n, lambda n: "".join(pick.choice("abcde") for _ in range(n)), lambda n: "漢é" * n,
        lambda n: "".join(pick.choice("!'-<|>") for _ in range(n)), lambda n: "".join(pick.choice(string.digits) for _ in range(n)),
        lambda n: "".join(pick.choice(["the ", "ab'll", " ", "\n\n", "'s"]) for _ in range(n // 3)),
        lambda n: "".join(pick.choice(["<|endoftext|>", "ab", ".", "<|"]) for _ in range(n // 5)),
        lambda n: "".join(pick.choice(" \t\n\x1c\x85") for _ in range(n)), lambda n: "😀" * n,
    ]
    for _ in range(400):
        text = "".join(pick.choice(parts)(pick.choice([1, 40, 300, 1500])) for _ in range(pick.randint(1, 5)))
        ids = ours.encode(text, 256)
        assert ids == theirs.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == text


def test_bpe_of_odd_rows(docs):
    theirs = Tokenizer.from_file(VOCABULARY)
    rows = ODD + [(20, "<|endoftext|>" * 300), (21, "x" * 9_000 + " " * 9_000 + "é" * 900)]
    got = {(r["doc_id"], r["decoded"]): r for r in bpe.bpe(docs(rows), VOCABULARY, leaf=1_000).collect()}
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        row = got[(i, t or "")]
        assert row["n_tokens"] == len(ids) and bytes(row["ids"]) == bpe.packed(ids)
    assert bpe.bpe(docs(rows), VOCABULARY).count() == len(rows)
    assert bpe.bpe(docs([]), VOCABULARY, digests=True).count() == 0


# --- language


def test_languages_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op7_language_id"](spark, sf).join(langs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97


def longest(text, sample):
    """Phrases of the greedy parse, by search."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def test_parse_counts_longest_phrases(monkeypatch):
    pick = random.Random(9)
    beyond = [chr(0x4E00 + i) for i in range(300)]
    samples = {
        "a": language_id.plain("the cat sat on the mat with another cat"),
        "b": language_id.plain("le chat est sur la table"),
        "c": language_id.plain("".join(pick.choice(beyond) for _ in range(900)) + " mat"),  # more letters than the table has
        "d": language_id.plain("ab" * 400 + "x" + "ab" * 300),
    }
    languages = language_id.Languages(samples)
    texts = ["the cat on a mat", "le chat, la table!", "zzz", "x" * 1_300, "thé", "ab" * 900 + "ba" * 300, "".join(pick.choice(beyond) for _ in range(700))]
    texts += [samples["c"][:600] + "q" + samples["c"][3:800], "cat on the mat " * 120, "a", "ab" * 2000]
    texts += ["".join(pick.choice("abcthe mx" + beyond[0]) for _ in range(pick.randint(1, 400))) for _ in range(30)]
    texts = [language_id.plain(t) for t in texts]
    for piece, lanes in ((512, 8192), (7, 8192), (16, 5), (3, 1)):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "LANES", lanes)
        got = languages.entropies(texts)
        for i, t in enumerate(texts):
            for j, name in enumerate(languages.names):
                assert round(got[i, j] * len(t) / languages.bits[j]) == longest(t, samples[name]), (piece, lanes, i, name)


def test_samples_of_languages(docs, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 100)
    rows = [(i, "the same copied text of many rows") for i in range(40)] + [(100 + i, f"other words {chr(97 + i) * 9} here") for i in range(8)]
    (sample,) = language_id.learn(docs(rows), F.lit(True)).values()
    assert sample.count("copied") <= 1 and 50 < len(sample) <= 110
    long = [(1, "w" * 500 + " end"), (2, "v" * 300 + " shorter")]
    (sample,) = language_id.learn(docs(long), F.lit(True)).values()
    assert sample == f" {'v' * 300} shorter "  # whole, though longer than the bound
    many = docs(rows).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 30))
    assert len(language_id.learn(many, F.lit(True))) == 30
    monkeypatch.setattr(language_id, "LANGUAGES", 29)
    with pytest.raises(ValueError, match="more than 29 languages"):
        language_id.learn(many, F.lit(True))


def test_language_of_odd_rows(docs):
    samples = {"en": language_id.plain("some words of a language")}
    got = of(language_id.identify(docs(ODD + [(30, "123 !?")]), samples), "doc_id", "lang_pred")
    want = [(i, "en" if any(c.isalpha() for c in t or "") else "und") for i, t in ODD + [(30, "123 !?")]]
    assert got == sorted(want, key=repr)
    assert {r["lang_pred"] for r in language_id.identify(docs(ODD), {}).collect()} == {"und"}
    assert language_id.identify(docs([]), samples).count() == 0
    assert language_id.learn(docs([(1, None), (2, "")]), F.lit(True)) == {}


# --- decontamination


def test_leaks_of_odd_rows(docs, spark):
    long = prose(40, 60)
    items = [(1, long), (2, prose(12, 61)), (10, "Word"), (3, None), (4, ""), (None, prose(25, 62)), (5, long), (6, "-")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    rows = ODD + [
        (40, f"{prose(30, 70)} {long.upper()} {prose(5, 71)}"), (41, " ".join(long.split()[5:16])), (42, " ".join(long.split()[:9])),
        (43, prose(12, 61) + "," + prose(25, 62)), (44, long + " " + long), (45, "a word " * 30),
    ]
    want = sorted([(i, *leaks(t, items)) for i, t in rows], key=repr)
    for extra in ({}, {"shard_words": 50}):
        got = decontaminate.contamination(docs(rows), bench, **extra)
        assert of(got, "doc_id", "n_words", "n_hit", "item_ids") == want
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert spans[44] == [[0, 2 * len(alnum(long))]]
    unique = [(i, t) for i, t in rows if i not in (5, None)]
    blocks = decontaminate.contamination(docs(unique), bench, block_bytes=100)
    assert of(blocks, "doc_id", "n_words", "n_hit", "item_ids") == sorted([(i, *leaks(t, items)) for i, t in unique], key=repr)
    assert decontaminate.contamination(docs([]), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs(rows), bench.limit(0)).collect()} == {0}


def test_several_blocks_answer_each_row_by_itself(docs, spark):
    items = [(1, prose(40, 60)), (2, prose(12, 61)), (None, prose(25, 62))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*ODD, (5, f"a {prose(40, 60)}"), (None, f"a b {prose(12, 61)}"), (None, prose(25, 62)), (5, prose(12, 61)), (5, prose(12, 61))]
    one, several = (decontaminate.contamination(docs(rows), bench, block_bytes=b) for b in (1 << 20, 100))
    cols = ("doc_id", "n_words", "spans", "n_hit", "item_ids")
    assert of(several, *cols) == of(one, *cols)
    assert of(several, *cols[:2], *cols[3:]) == sorted([(i, *leaks(t, items)) for i, t in rows], key=repr)


# --- licences


def test_expressions():
    found = lambda s: [(round(v, 2), x, t) for v, x, t in license_scan.expressions(f"// spdx-license-identifier: {s}\n")]
    assert found("mit") == [(1.0, ["mit"], "mit")]
    assert found("gpl-2.0 or mit and cc-by-nc-4.0") == [(0.4, ["gpl-2.0", "mit", "cc-by-nc-4.0"], "(gpl-2.0 or (mit and cc-by-nc-4.0))")]
    assert found("(gpl-2.0 or mit) and apache-2.0 with llvm-exception")[0][2] == "((gpl-2.0 or mit) and apache-2.0 with llvm-exception)"
    assert found("mit or") == [] and found("(mit") == [] and found("mit some prose")[0][2] == "mit"


def test_licences_of_odd_rows(docs):
    rows = ODD + [
        (60, "Under the MIT License. Under the mit\nlicense"), (61, "CC BY-NC 4.0, cc by nc"), (62, "Apache License, Version 2.0"),
        (63, "SPDX-License-Identifier: (MIT OR GPL-2.0)\nx"), (64, "All rights reserved"), (65, "under the mit licenses"),
    ]

    def plain(text):
        w = alnum(text)
        at = [(k, x) for p, x in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))

    got = license_scan.scan_licences(docs(rows))
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert of(got, *cols) == sorted([(i, *plain(t)) for i, t in rows], key=repr)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[63]["labels"] == "gpl-2.0,mit" and by[63]["freedom"] == 1.0 and by[63]["score"] == 1.0
    assert by[64]["labels"] == "all-rights-reserved" and by[1]["score"] == 0
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in by.values())
    assert license_scan.scan_licences(docs([])).count() == 0


# --- near duplicates


def test_components_of_odd_rows(docs):
    base = prose(120, 80).split()
    rows = list(ODD)
    for k in range(30):  # a chain in which neighbours are alike and ends are not
        rows.append((100 + k, " ".join(base[3 * k : 3 * k + 60])))
    pick = random.Random(9)
    for k in range(40):  # noisy copies around the limit
        w = prose(100, 81).split()
        for _ in range(pick.randint(1, 6)):
            w[pick.randrange(100)] = f"z{pick.randrange(9)}"
        rows.append((200 + k, " ".join(w)))
    for block in (1_000, 5):
        got = ngram_join.ngram_components(docs(rows), block=block)
        assert of(got, "doc_id", "n_shingles", "component_id") == sorted(near(rows), key=repr)
    assert ngram_join.ngram_components(docs([])).count() == 0
    assert spaced(" ") == []


def test_null_ids_link_and_bridge(docs):
    base = prose(120, 82).split()
    part = lambda k: " ".join(base[k : k + 60])
    rows = [(5, prose(90, 83)), (None, prose(90, 83) + " tail"), (8, part(0)), (None, part(5)), (9, part(10)), (None, prose(50, 84)), (None, prose(50, 84) + " x")]
    pick = random.Random(10)
    for k in range(40):  # pairs for the later rounds, half of them without an id
        w = prose(100, 85).split()
        for _ in range(pick.randint(1, 6)):
            w[pick.randrange(100)] = f"z{pick.randrange(9)}"
        rows.append((200 + k if k % 2 else None, " ".join(w)))
    want = near(rows)
    assert [c for _, _, c in want[:5]] == [5, 5, 8, 8, 8] and near([rows[2], rows[4]])[1][2] == 9
    for block in (1_000, 5):
        got = ngram_join.ngram_components(docs(rows), block=block)
        assert of(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


# --- queries and pipeline


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    want = duck.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    places = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[p] for p in places)) for r in want.fetchall())


def test_rows_without_an_id_are_not_held_out(docs, tmp_path, spark):
    rows = docs([(i, prose(30, i)) for i in range(40)] + [(None, prose(30, 99))])
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op2_quality", "op7_language_id"):
        (row,) = QUERIES[name](spark, str(tmp_path)).where("doc_id is null").collect()
        assert row["held_out"] is False


def test_queries_read_every_row(spark):
    n = {t: len(given(t)) for t in ("documents", "pages")}
    for name, query in QUERIES.items():
        if name == "op13_hard_negatives":  # rows of pairs, held against SQL above
            continue
        assert query(spark, SF).count() == n["pages" if name == "op5_warc" else "documents"], name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, given("documents")
    items = [(b["item_id"], b["text"]) for b in given("benchmark")]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "BPE encoding and decoding":
            break
        assert out.columns == columns
        docs = corpus_pipeline.stored(out, "stage")
        before, kept = kept, [r.asDict() for r in docs.collect()]
        ids = {r["doc_id"] for r in kept}
        if name == "exact dedup":
            least = {}
            for r in before:
                least[normal(r["text"])] = min(least.get(normal(r["text"]), r["doc_id"]), r["doc_id"])
            assert ids == set(least.values())
        if name == "n-gram Jaccard join":
            assert ids == {c for _, _, c in near([(r["doc_id"], r["text"]) for r in before])}
        if name == "benchmark decontamination":
            assert ids == {r["doc_id"] for r in before if not leaks(r["text"], items)[1]}
        assert 0 < len(ids) == len(kept) <= len(before)
    theirs = Tokenizer.from_file(VOCABULARY)
    want = [(r["doc_id"], sha(r["text"]), bpe.packed(theirs.encode(r["text"], add_special_tokens=False).ids)) for r in kept]
    assert of(out, "doc_id", "decoded_sha256", "ids") == sorted(((i, d, bytearray(x)) for i, d, x in want), key=repr)


def test_pipeline_drops_rows_without_or_with_repeated_ids(spark, docs):
    leak = next(b["text"] for b in given("benchmark") if len(alnum(b["text"])) >= 10)
    texts = {k: prose(90, 300 + k) for k in range(6)}
    rows = [
        (None, texts[0]), (4, texts[0]), (None, texts[0]), (4, texts[0]), (None, texts[1]), (None, texts[1]),
        (None, texts[2]), (9, texts[2] + " tail"), (None, texts[3]), (None, texts[3] + " end"),
        (7, texts[4]), (7, texts[5]), (7, texts[4] + " more"), (3, texts[5] + " b"), (None, "x " + leak), (8, f"{prose(200, 321)} {leak}"), (8, prose(40, 320)),
    ]
    frame = docs(rows)
    stage = dict(corpus_pipeline.STAGES)
    exact = corpus_pipeline.stored(stage["exact dedup"](spark, frame, SF), "stage")
    assert exact.columns == frame.columns
    assert of(exact, "doc_id", "text") == sorted([rows[1], rows[4], *rows[6:]], key=repr)
    near_kept = corpus_pipeline.stored(stage["n-gram Jaccard join"](spark, exact, SF), "stage")
    kept = of(near_kept, "doc_id", "text")
    clear = [rows[1], rows[4], rows[7], rows[13], *rows[14:]]
    assert all(r in kept for r in clear) and len(kept) == len(clear) + 2
    assert sum(r in kept for r in (rows[8], rows[9])) == sum(r in kept for r in (rows[10], rows[12])) == 1
    clean = of(stage["benchmark decontamination"](spark, near_kept, SF), "doc_id", "text")
    assert clean == [r for r in kept if r not in (rows[14], rows[15])]


def test_exact_dedup_moves_only_rows_that_may_be_marked(spark, docs, monkeypatch, capsys):
    rows = [(i, prose(40, 400 + i % 380)) for i in range(400)] + [(3, prose(40, 403))]
    stage = dict(corpus_pipeline.STAGES)["exact dedup"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = stage(spark, docs(rows), SF)
        want = sorted([(i, t) for i, t in rows[:380]], key=repr)
        assert of(kept, "doc_id", "text") == want
        kept.explain("formatted")
        moved = re.findall(r"rowCount=(\d+)", capsys.readouterr().out)
        assert moved and sum(map(int, moved)) < len(rows)
        monkeypatch.setattr(corpus_pipeline, "SIEVE", 64)  # nearly every row passes it
        assert of(stage(spark, docs(rows), SF), "doc_id", "text") == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pipeline_of_odd_rows(spark, docs):
    frame = docs(ODD)
    for _, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stored(stage(spark, frame, SF), "stage")
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.stored(stage(spark, empty, SF), "stage")
    assert frame.count() > 0 and empty.count() == 0
