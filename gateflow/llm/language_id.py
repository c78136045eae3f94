"""Language by cross-parsing: the language whose sample needs fewest phrases wins.

Of each language a sample of labelled text is learned as a suffix automaton. A
text is cut from left to right into the longest phrases that occur in a
language's sample; a character that doesn't occur at all is a phrase alone. The
number of phrases times the bits that point at a phrase in the sample, per
character, is the cross-parsing entropy. The smallest entropy wins, ties go to the
language first in order.

Text is lower-cased; every run of other characters than letters is one blank. Texts are
parsed whole. Many pieces of PIECE characters are parsed at once, one character each per
step, each as though a phrase began there; then every piece is parsed again with the
phrase that reaches into it, as far as the first place where both parses are in the same
state, from where on they agree. So the result is that of one parse from left to right.

A language's sample are SAMPLE_DOCS different texts at most, whole, those first by a
digest of the text, and of them as many as have SAMPLE_CHARS characters in all; longer
texts are passed over, unless a language has no other, then its shortest is taken. More
than LANGUAGES languages stop the run. Transitions by the DENSE most frequent letters of
a language are a table, those by other letters are sorted keys: a worker holds about
4 * (DENSE + 1) bytes a state, two states a character at most, so 13 MB for a language of
30 letters, and 400 MB for LANGUAGES of them.

Null texts and texts without a letter give `und` and score 0, as do all texts if
nothing was learned. Rows are independent; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateflow.llm.tables import prepared, stored

UNDETERMINED = "und"
#: Sample per language: different texts, and characters of all of them; languages.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGES = 60, 60_000, 64
#: Letters of a language whose transitions are a table.
DENSE = 48
PIECE = 512
#: Pieces parsed side by side.
LANES = 8_192
_OTHER = regex.compile(r"[^\p{L}]+")


def plain(text: str | None) -> str:
    """Lower-cased letters between single blanks; empty without letters."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


class SuffixAutomaton:
    """States of all substrings of a text: link, length and transitions."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            state = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p < 0:
                self.link[state] = 0
            else:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[state] = q
                else:
                    copy = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[copy] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[state] = copy
            last = state

    def _state(self, length: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1


class Transitions:
    """Moves of an automaton for many states at once. A move that doesn't exist ends the
    phrase: it is given as -1 less the root's move by the same letter, so -1 tells that
    the sample lacks the letter."""

    def __init__(self, sample: str):
        automaton = SuffixAutomaton(sample)
        counts: dict[str, int] = {}
        for c in sample:
            counts[c] = counts.get(c, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.codes = np.zeros(0x110000, np.int32)  # 0 is an unknown letter
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.dense, self.alphabet = min(DENSE, len(letters)) + 1, len(letters) + 1
        code = {c: i + 1 for i, c in enumerate(letters)}
        table = np.full((len(automaton.next), self.dense), -1, np.int32)
        root = np.zeros(self.alphabet, np.int64)
        rare: dict[int, int] = {}
        for state, following in enumerate(automaton.next):
            for c, to in following.items():
                k = code[c]
                if k < self.dense:
                    table[state, k] = to
                else:
                    rare[state * self.alphabet + k] = to
                if not state:
                    root[k] = to
        self.table = np.where(table < 0, -1 - root[: self.dense].astype(np.int32), table).ravel()
        self.missing = -1 - root
        keys = np.array(sorted(rare), np.int64)
        self.keys, self.targets = keys, np.array([rare[k] for k in keys.tolist()], np.int64)

    def __call__(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if self.dense == self.alphabet:
            return self.table[states * self.dense + codes]
        rare = codes >= self.dense
        moves = self.table[states * self.dense + np.where(rare, 0, codes)].astype(np.int64)
        if rare.any():
            keys = states[rare].astype(np.int64) * self.alphabet + codes[rare]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            moves[rare] = np.where(self.keys[at] == keys, self.targets[at], self.missing[codes[rare]])
        return moves


def _step(moves: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases that end, states) after moves from states."""
    miss = moves < 0
    # a letter that the sample lacks is a phrase alone, after the one it ends
    return miss.astype(np.int32) + ((moves == -1) & (states != 0)), np.where(miss, -1 - moves, moves)


class Languages:
    """Automata of the samples, and the parse of many texts at once."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.automata = [Transitions(samples[name]) for name in self.names]
        self.bits = [float(np.log2(len(samples[name]) + 1)) for name in self.names]

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per character of each text (rows) under each language (columns)."""
        phrases = np.zeros((len(texts), len(self.names)))
        pieces = [(i, k) for i, t in enumerate(texts) for k in range(0, len(t), PIECE)]
        carried = np.zeros(len(self.names), np.int64)  # where the last text of a group goes on in the next
        for at in range(0, len(pieces), LANES):
            lane = pieces[at : at + LANES]
            owner = np.array([i for i, _ in lane])
            joined = np.array([k > 0 for _, k in lane])
            parts = [texts[i][k : k + PIECE] for i, k in lane]
            points = np.zeros((len(lane), PIECE), np.uint32)
            sizes = np.array([len(x) for x in parts])
            points[np.arange(PIECE) < sizes[:, None]] = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
            last = np.append(owner[1:] != owner[:-1], at + LANES >= len(pieces) or pieces[at + LANES][1] == 0)
            for j, automaton in enumerate(self.automata):
                ended, state = _parsed(automaton, points, sizes, joined, int(carried[j]))
                np.add.at(phrases[:, j], owner, ended + (last & (state != 0)))
                carried[j] = state[-1]
        chars = np.array([max(1, len(t)) for t in texts])
        return phrases * np.array(self.bits) / chars[:, None]


def _parsed(move: Transitions, points: np.ndarray, sizes: np.ndarray, joined: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each piece, and the state behind it, where a `joined` piece
    goes on from the one before it (the first of all from the state `carried`)."""
    lanes = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    steps = np.ascontiguousarray(move.codes[points[order]].T)
    live = np.searchsorted(-sizes[order], -np.arange(PIECE), side="left")  # lanes longer than the step
    states, counts = np.zeros((PIECE, lanes), np.int32), np.zeros((PIECE, lanes), np.int16)
    state, ended = np.zeros(lanes, np.int64), np.zeros(lanes, np.int32)
    for k, m in enumerate(live.tolist()):
        if not m:
            break
        more, state[:m] = _step(move(state[:m], steps[k, :m]), state[:m])
        ended[:m] += more
        states[k, :m], counts[k, :m] = state[:m], ended[:m]
    place = np.empty(lanes, np.int64)
    place[order] = np.arange(lanes)  # lane of each piece
    alone, final = ended[place], state[place].copy()
    total, behind = alone.copy(), final.copy()
    before = np.append(carried, final[:-1])
    fix = np.flatnonzero(joined & (before != 0))
    while len(fix):
        start, here, got = before[fix], place[fix], np.zeros(len(fix), np.int32)
        result, out = np.zeros(len(fix), np.int32), np.zeros(len(fix), np.int64)
        going, at = np.arange(len(fix)), start.astype(np.int64)
        for k in range(PIECE):
            more, now = _step(move(at, steps[k, here[going]]), at)
            got[going] += more
            met = now == states[k, here[going]]
            stop = met | (sizes[fix[going]] == k + 1)
            rest = alone[fix[going]] - counts[k, here[going]]
            done = going[stop]
            result[done] = got[done] + np.where(met, rest, 0)[stop]
            out[done] = np.where(met, final[fix[going]], now)[stop]
            going, at = going[~stop], now[~stop]
            if not len(going):
                break
        total[fix] = result
        changed = behind[fix] != out
        behind[fix] = out
        after = fix[changed] + 1
        after = after[(after < lanes)]
        after = after[joined[after]]
        before[after] = behind[after - 1]
        fix = after
    return total, behind


def learn(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, str]:
    """Sample text per language from rows that `usable` marks, see above."""
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    rows = docs.where(usable & F.col(lang).isNotNull() & (length > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("turn"), length.alias("size"), F.col(text).alias("text")
    )
    found = rows.select("lang").distinct().limit(LANGUAGES + 1).count()
    if found > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled")
    # places by digest and length alone; of equal texts one row per task is shuffled
    different = rows.groupBy("lang", "turn").agg(F.max("size").alias("size"))
    fits = F.when(F.col("size") > SAMPLE_CHARS, F.col("size")).otherwise(0)  # longer ones last, the shortest first
    by_turn = Window.partitionBy("lang").orderBy(fits, "turn")
    first = different.withColumn("place", F.row_number().over(by_turn)).where(F.col("place") <= SAMPLE_DOCS)
    so_far = F.sum("size").over(by_turn.rowsBetween(Window.unboundedPreceding, 0))
    picked = first.withColumn("chars", so_far).where((F.col("chars") <= SAMPLE_CHARS) | (F.col("place") == 1))
    picked = stored(picked.select("lang", "turn", "place"), "language-picks")  # LANGUAGES * SAMPLE_DOCS rows at most
    chosen = rows.join(F.broadcast(picked), ["lang", "turn"]).groupBy("lang", "place").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "place").collect():  # bounded by the parameters above
        samples.setdefault(r["lang"], []).append(r["text"])
    plains = {k: "".join(map(plain, v)) for k, v in samples.items()}
    return {k: v for k, v in plains.items() if v}


_built: dict[tuple, Languages] = {}


def _languages(samples: dict[str, str]) -> Languages:
    """The worker's automata: built once, not once a task."""
    key = tuple(sorted(samples.items()))
    if key not in _built:
        _built.clear()
        _built[key] = Languages(samples)
    return _built[key]


def identify(docs: DataFrame, samples: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, lang_pred, score (0 to 1: how much fewer bits
    the winner needs than the next) and its bits per character."""
    given = docs.sparkSession.sparkContext.broadcast(samples)  # bounded by the sample's parameters
    prepared(docs.sparkSession)
    names = [doc_id, "lang_pred", "score", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _languages(given.value) if given.value else None
        for batch in batches:
            texts = [plain(t.as_py()) for t in batch.column(1)]
            pred, score, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if languages and texts:
                entropy = languages.entropies(texts)
                best = entropy.argmin(axis=1)
                for i, t in enumerate(texts):
                    if not t:
                        continue
                    low = entropy[i, best[i]]
                    others = np.delete(entropy[i], best[i])
                    pred[i], bits[i] = languages.names[best[i]], float(low)
                    score[i] = float(1 - low / others.min()) if len(others) else 1.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=names
            )

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{doc_id} long, lang_pred string, score double, bits double")
