"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base rule: e-mail addresses, IPv4 addresses, card numbers that pass Luhn's check,
and phone numbers, each kind by its own leftmost non-overlapping matches.

Bootstrapping: every base match is an instance and a seed; every other word of five
characters or more with a digit or an @, without quotes, brackets and other marks
around it, is an instance unless it overlaps a base match. Such a word is a seed too if
it has the shape of a secret: 16 to 512 letters, digits and signs of encodings in which
runs of digits and of others take turns four times or more. The two words before an
instance are its pattern, whatever they hold; for a base match inside a word, those
before that word. Instances with fewer words before them have no pattern. Patterns and
instances form a graph, scored in rounds until no further pattern is trusted: a pattern
by the share of its occurrences that are trusted instances, an instance by the patterns
it occurs in (noisy or). Patterns that end up with a high score and enough trusted
instances mark all their tokens beside the base matches as personal data of the kind
`context`, whatever their shape; a secret in no trusted context is not marked.

Everything is DataFrame expressions. Places come from the matches and the gaps
between them, summed in blocks, so a text with many matches stays linear. Patterns
are written so that no group repeats by recursion: texts may be of any length.

Null counts as empty; empty texts have no spans. Rows that repeat an id are told
apart by a digest of the text, equal rows get equal answers. An empty table gives
an empty result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")
#: Leftmost matches of the base patterns. `\\G` is the end of the match before, so a
#: match may begin there or where a run begins; possessive loops never give back.
#: Of card numbers only whole chains of digits with 16 to 19 of them are matched.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)(?=\S*[0-9@])\S++"
#: The last two words of a text; each word is tried once.
LAST_TWO = r"(?<!\S)\S++\s++\S++\s*+\z"
TRUST, SUPPORT, BLOCK = 0.75, 3, 400
#: Scores change ever less; a graph that still gains patterns after so many rounds stops.
ROUNDS = 12
#: Marks around a token that are not part of it, and the shape of a secret.
OPENING, CLOSING = r"^[\"'`(<\[{]+", r"[\"'`)>\]}.,;:!?#*%$]+$"
SECRET = r"^[A-Za-z+/_=-]*+(?:[0-9]++[A-Za-z+/_=-]++){4,}+[0-9]*+$"
SECRET_LENGTH = (16, 512)
#: Characters of an instance that is no base match.
LEAST = 5
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "array<struct<start:bigint,end:bigint>>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(items: Column, size) -> Column:
    """Running sums of size(item)."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: let(a["at"] + size(x), lambda at: F.struct(at.alias("at"), F.array_append(a["out"], at).alias("out")))
    return F.aggregate(items, start, step, lambda a: a["out"])


def found(text: Column, pattern: str) -> Column:
    """Matches as an array of structs: start, end (code points), match, and before,
    the text since the match before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def sized(match: Column, gap: Column) -> Column:
        return F.transform(
            match,
            lambda m, i: F.struct(
                F.length(F.get(gap, i)).cast("long").alias("gap"),
                F.length(m).cast("long").alias("size"),
                m.alias("match"),
                F.get(gap, i).alias("before"),
            ),
        )

    def blocks(rows: Column) -> Column:
        of = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))
        cut = F.transform(of, lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(cut, lambda b: F.struct(b.alias("rows"), _sums(b, lambda x: x["gap"] + x["size"]).alias("ends")))

    def placed(inner: Column) -> Column:
        starts = F.concat(F.array(F.lit(0).cast("long")), _sums(inner, lambda b: F.element_at(b["ends"], -1)))
        span = lambda x, end: F.struct(
            (end - x["size"]).alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before")
        )
        block = lambda b, start: F.transform(
            b["rows"], lambda x, i: let(start + F.get(b["ends"], i), lambda end: span(x, end))
        )
        return F.flatten(
            let(starts, lambda at: F.transform(inner, lambda b, k: let(F.get(at, k), lambda start: block(b, start))))
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string>>")
    whole = lambda m: let(gaps, lambda g: let(sized(m, g), lambda rows: let(blocks(rows), placed)))
    return let(matches, lambda m: F.when(F.size(m) > 0, whole(m)).otherwise(none))


def _digits(match: Column) -> Column:
    return F.translate(match, " ().-+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right is doubled."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd")),
        lambda a, c: F.struct(
            (a["sum"] + F.when(a["odd"] == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))).alias("sum"),
            (1 - a["odd"]).alias("odd"),
        ),
        lambda a: a["sum"],
    )
    return total % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def base_matches(text: Column, kind: str) -> Column:
    """Spans of one kind and their text; the pattern is tried where its telling
    characters occur."""
    there = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    kept = F.filter(found(text, PATTERNS[kind]), lambda m: passes(kind, m["match"]))
    spans = F.transform(kept, lambda m: F.struct(*(m[c].alias(c) for c in ("start", "end", "match"))))
    return F.when(there, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))


def last_of(items: Column, holds) -> Column:
    """The last of the items for which `holds`, by bisection: it holds for the first
    ones only. Null if it holds for none."""
    def halved(a: Column, _: Column) -> Column:
        bounds = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        return let(middle, lambda k: F.when(holds(F.get(items, k)), bounds(k + 1, a["high"])).otherwise(bounds(a["low"], k)))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(items) + 1.0)).cast("int") + 1)
    whole = F.struct(F.lit(0).alias("low"), F.size(items).alias("high"))
    return F.aggregate(steps, whole, halved, lambda a: F.get(items, a["low"] - 1))


def tokens(text: Column) -> Column:
    """Words with a digit or an @: start, end and instance without the marks around it,
    and pattern (two words before, digits as 0; null where the text has fewer words
    there)."""
    opened = lambda m: F.regexp_replace(m["match"], OPENING, "")
    tell = lambda m: F.regexp_replace(opened(m), CLOSING, "")

    def pattern(of: Column, m: Column, i: Column) -> Column:
        # tokens are whole words, so two of them and their gaps hold two words
        last = F.get(of, i - 1)
        before = F.concat_ws("", F.get(of, i - 2)["match"], last["before"], last["match"], m["before"])
        words = F.trim(F.regexp_replace(F.regexp_extract(before, LAST_TWO, 0), r"\s+", " "))
        return F.nullif(F.translate(F.lower(words), "123456789", "000000000"), F.lit(""))

    def told(of: Column) -> Column:
        return F.transform(
            of,
            lambda m, i: F.struct(
                (m["end"] - F.length(opened(m))).alias("start"),
                (m["end"] - F.length(opened(m)) + F.length(tell(m))).alias("end"),
                tell(m).alias("instance"),
                pattern(of, m, i).alias("pattern"),
                m["start"].alias("word"),
            ),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,instance:string,pattern:string,word:bigint>>")
    return F.when(text.rlike("[0-9@]"), let(found(text, TOKEN), told)).otherwise(none)


def instances() -> Column:
    """Base matches, as seeds with the pattern of the token they begin in, and tokens
    of some length that overlap none, seeds if they look like secrets; over columns KINDS
    and `token`."""

    def seed(m: Column) -> Column:
        there = last_of(F.col("token"), lambda t: t["word"] <= m["start"])
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("instance"), there["pattern"].alias("pattern"),
            F.lit(True).alias("seed"), F.lit(True).alias("base"),
        )

    def beside(tokens: Column, kind: str) -> Column:
        # matches of one kind lie one after another
        last = lambda t: last_of(F.col(kind), lambda m: m["start"] < t["end"])
        kept = F.filter(tokens, lambda t: F.coalesce(last(t)["end"] <= t["start"], F.lit(True)))
        return F.when(F.size(kind) > 0, kept).otherwise(tokens)

    free = F.filter("token", lambda t: F.length(t["instance"]) >= LEAST)
    for kind in KINDS:
        free = beside(free, kind)
    secret = lambda x: F.length(x).between(*SECRET_LENGTH) & F.when(F.length(x) <= SECRET_LENGTH[1], x).rlike(SECRET)
    told = lambda t: F.struct(
        *(t[c].alias(c) for c in ("start", "end", "instance", "pattern")), F.coalesce(secret(t["instance"]), F.lit(False)).alias("seed"), F.lit(False).alias("base")
    )
    others = F.transform(free, told)
    return F.concat(*(F.transform(k, seed) for k in KINDS), others)


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """(pattern) of those that the rounds end up trusting. Edges: pattern, instance,
    seed; they are counted per pair before anything is joined."""
    graph = stored(
        edges.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seed").cast("double")).alias("score")),
        "pii-graph",
    )
    known = -1
    for _ in range(ROUNDS):
        # patterns with support, the graph's small part, go on
        scored = (
            graph.groupBy("pattern")
            .agg(
                (F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 1)).alias("trust"),
                F.count_if(F.col("score") > 0).alias("support"),
            )
            .where((F.col("support") >= SUPPORT) & (F.col("trust") >= TRUST))
        )
        trusted = stored(scored.select("pattern", "trust"), "pii-trusted")
        n = trusted.count()
        if n == known:  # scores only rise, so none has gone either
            break
        known = n
        lifted = (
            graph.join(trusted, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("lift"))
        )
        graph = stored(
            graph.join(lifted, "instance", "left").select(
                "pattern", "instance", "n", F.greatest("score", F.coalesce("lift", F.lit(0.0))).alias("score")
            ),
            "pii-graph",
        )
    return trusted.select("pattern")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, one array of spans per base kind, `context`
    (spans that the contexts add)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), body.alias("text"))
    read = stored(
        rows.select("id", F.xxhash64("text").alias("key"), *(base_matches(F.col("text"), k).alias(k) for k in KINDS), tokens(F.col("text")).alias("token")),
        "pii-spans",
    )
    edges = read.where(F.size("token") > 0).select("id", "key", F.explode(instances()).alias("t")).select("id", "key", "t.*").where("pattern is not null")
    patterns = stored(trusted_patterns(edges), "pii-patterns")
    added = (
        edges.where("not base")
        .join(patterns, "pattern")
        .groupBy("id", "key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("context"))
        .withColumnsRenamed({"id": "id_added", "key": "key_added"})
    )
    on = F.col("id").eqNullSafe(F.col("id_added")) & (F.col("key") == F.col("key_added"))
    none = F.array().cast(_SPAN)
    spans = [F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias(k) for k in KINDS]
    return read.join(added, on, "left").select(F.col("id").alias(doc_id), *spans, F.coalesce("context", none).alias("context"))


def written(kinds: tuple[str, ...]) -> Column:
    """Spans as kind:start:end, by kind and then start, joined by commas."""
    one = lambda kind: F.transform(
        kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.concat_ws(",", *(one(k) for k in kinds))
