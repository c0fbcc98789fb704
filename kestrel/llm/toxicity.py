"""Toxicity by a learned lexicon, searched with Levenshtein automata over a trie (operator 3)."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import with_columns_in_arrow
from kestrel.llm.ngram_join import Shingler
from kestrel.session import materialise

WORD = re.compile(r"[^\W_]+")
#: Quotation marks that open and close, and words that report what someone else said.
OPENING, CLOSING = "\"“„«‹", "\"”“»›"
REPORTING = frozenset(
    "said says quote quoted quoting called calls wrote writes word term sagte sagt nannte zitat wort dit disait appelle mot "
    "citation dijo dice llama palabra cita".split()
)
ADDRESS = frozenset("you your youre du dich dein sie ihr tu toi te vous votre tú te usted vosotros eres".split())
STEMS = (4, 5, 6, 7)
#: Labelled rows of each class that are learned from; what a lexicon holds is bounded by their words.
POSITIVES, NEGATIVES = 4000, 8000
#: What an entry must have: a lower bound of its log odds, and evidence (twice the log likelihood ratio against independence) that
#: chance gives about one term in ten thousand.
LEAST_ODDS, EVIDENCE = 1.3, 15.0
FEATURES = 7


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def words_of(text: str | None) -> list[str]:
    """Words are cut in the text as it is and lower-cased each by itself: lower-casing may change a text's length."""
    raw = WORD.findall(text or "")
    lower = {w: w.lower() for w in set(raw)}
    return [lower[w] for w in raw]


def terms_of(words: Iterable[str]) -> set[str]:
    """Whole words of three letters on, and stems (marked `*`) of words that go on after them."""
    out = set()
    for w in set(words):
        if len(w) >= 3 and not w.isdigit():
            out.add(w)
            out.update(f"{w[:n]}*" for n in STEMS if len(w) > n)
    return out


NOTHING = (0.0, 0)


def letters(word: str) -> int:
    """The set of a word's letters as bits, some letters sharing one."""
    out = 0
    for c in word:
        out |= 1 << ord(c) % 61
    return out


class Lexicon:
    """A trie of words and stems. A Levenshtein automaton of a text's word runs down the trie with it: both advance on
    a letter, and a branch ends as soon as the automaton has no state left."""

    def __init__(self, weights: dict[str, float], distance: int = 1, least: int = 5) -> None:
        self.distance, self.least = distance, least
        self.next: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.starts: dict[str, list[tuple[int, int]]] = {}  # half a word -> (length, letters) of each word
        self.ends: dict[str, list[tuple[int, int]]] = {}
        self.stems: set[str] = set()
        for term, weight in weights.items():
            body = term.rstrip("*")
            at = 0
            for c in body:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(0.0)
                    self.stem.append(0.0)
                at = self.next[at][c]
            if term.endswith("*"):
                self.stem[at] = max(self.stem[at], weight)
                self.stems.add(body)
            else:
                self.word[at] = max(self.word[at], weight)
                if len(body) >= least:
                    half = len(body) // 2
                    self.starts.setdefault(body[:half], []).append((len(body), letters(body)))
                    self.ends.setdefault(body[half:], []).append((len(body), letters(body)))
        self.start_sizes = sorted({len(a) for a in self.starts})
        self.end_sizes = sorted({len(b) for b in self.ends})
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.known: dict[str, tuple[float, int]] = {}
        self.others: set[str] = set()  # words that match nothing

    def exact(self, word: str) -> float:
        at, best = 0, 0.0
        for n, c in enumerate(word):
            if (at := self.next[at].get(c, -1)) < 0:
                return best
            if n + 1 < len(word):
                best = max(best, self.stem[at])
        return max(best, self.word[at])

    def near(self, word: str) -> float:
        """The heaviest whole word within the distance, by the automaton (position, errors) over the trie."""
        k, n = self.distance, len(word)

        def closed(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            out = set(states)
            for i, e in states:
                for d in range(1, k - e + 1):
                    if i + d <= n:
                        out.add((i + d, e + d))
            return frozenset(out)

        best, todo = 0.0, [(0, closed({(0, 0)}))]
        while todo:
            at, states = todo.pop()
            if self.word[at] > best and any(i == n for i, _ in states):
                best = self.word[at]
            for c, to in self.next[at].items():
                moved = set()
                for i, e in states:
                    if i < n and word[i] == c:
                        moved.add((i + 1, e))
                    elif e < k:
                        moved.add((i, e + 1))
                        if i < n:
                            moved.add((i + 1, e + 1))
                if moved:
                    todo.append((to, closed(moved)))
        return best

    def may_be_near(self, word: str) -> bool:
        """One edit leaves the first or the second half of a term as it is and changes at most two letters of its set of letters, so
        nothing is missed here."""
        halves = [h for s in self.start_sizes if (h := self.starts.get(word[:s]))] + [h for s in self.end_sizes if (h := self.ends.get(word[-s:]))]
        if not halves:
            return False
        n, own = len(word), letters(word)
        return any(-1 <= n - m <= 1 and (own ^ x).bit_count() <= 2 for h in halves for m, x in h)

    def look(self, word: str) -> tuple[float, int]:
        """(weight, edits); weight 0 where nothing matches."""
        if word in self.others:
            return NOTHING
        found = self.known.get(word)
        if found is None:
            found = self.exact(word), 0
            if not found[0] and len(word) + 1 >= self.least and self.may_be_near(word):
                found = self.near(word), 1
            if len(self.known) + len(self.others) > 300_000:
                self.known.clear()
                self.others.clear()
            if found[0]:
                self.known[word] = found
            else:
                self.others.add(word)
                return NOTHING
        return found


def hits(lexicon: Lexicon, text: str | None, window: int = 8) -> tuple[list[tuple], int]:
    """([(place among the words, start, end, weight, edits, quoted, addressed)], words)."""
    body = text or ""
    words = words_of(body)
    look = lexicon.look
    marked = {w for w in set(words) if look(w)[0] > 0}
    if not marked:
        return [], len(words)
    spans = [m.span() for m in WORD.finditer(body)]
    marks = [i for i, c in enumerate(body) if c in OPENING or c in CLOSING]
    out = []
    for k, w in enumerate(words):
        if w in marked:
            a, b = spans[k]
            before, after = words[max(0, k - window) : k], words[k + 1 : k + 1 + window]
            first, last = spans[max(0, k - window)][0], spans[min(len(spans) - 1, k + window)][1]
            i, j = bisect.bisect_left(marks, a), bisect.bisect_left(marks, b)
            left = i > 0 and marks[i - 1] >= first and body[marks[i - 1]] in OPENING
            right = j < len(marks) and marks[j] < last and body[marks[j]] in CLOSING
            quoted = (left and right) or not REPORTING.isdisjoint(before[-4:])
            addressed = not ADDRESS.isdisjoint(before[-4:]) or not ADDRESS.isdisjoint(after[:4])
            out.append((k, a, b, *look(w), quoted, addressed))
    return out, len(words)


def features(found: list[tuple], n_words: int, window: int = 20) -> list[float]:
    """What the scorer sees: summed, strongest and densest abuse with quoted terms discounted, misspellings apart."""
    if not found:
        return [0.0] * FEATURES
    felt = [w * (0.35 if quoted else 1.2 if addressed else 1.0) * (0.6 if edits else 1.0) for _, _, _, w, edits, quoted, addressed in found]
    exact = [f for f, h in zip(felt, found) if not h[4]]
    most = run = 0.0
    left = 0
    for k, f in enumerate(felt):
        run += f
        while found[k][0] - found[left][0] >= window:
            run -= felt[left]
            left += 1
        most = max(most, run)
    return [
        math.log1p(sum(exact)),
        max(exact, default=0.0),
        math.log1p(100 * sum(felt) / max(20, n_words)),
        math.log1p(most),
        sum(h[5] for h in found) / len(found),
        math.log1p(sum(f for f, h in zip(felt, found) if h[4])),
        math.log1p(len(found)),
    ]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    slopes: list[float] = field(default_factory=lambda: [0.0] * FEATURES)


def lower_odds(pos: float, neg: float, n_pos: int, n_neg: int) -> float:
    """A lower bound of the log odds ratio of a term between toxic and clean documents."""
    ratio = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
    return ratio - 1.28 * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def evidence(pos: float, neg: float, n_pos: int, n_neg: int) -> float:
    whole, seen = n_pos + n_neg, pos + neg
    cells = ((pos, seen * n_pos), (neg, seen * n_neg), (n_pos - pos, (whole - seen) * n_pos), (n_neg - neg, (whole - seen) * n_neg))
    return 2 * sum(o * math.log(o * whole / e) for o, e in cells if o > 0)


def lower_odds_of(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    ratio = F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))
    return ratio - 1.28 * F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def lexicon_from(counts: dict[str, tuple[float, float]], n_pos: int, n_neg: int, least_odds: float = LEAST_ODDS) -> dict[str, float]:
    """term -> weight. Whole words stay beside a stem, as a misspelling is searched among whole words alone."""
    known = {t: x for t, x in counts.items() if evidence(*x, n_pos, n_neg) >= EVIDENCE}
    scored = {t: s for t, (p, n) in known.items() if (s := lower_odds(p, n, n_pos, n_neg)) >= least_odds}
    best: dict[str, float] = {}
    inside: dict[str, float] = {}  # beginnings of entries -> the highest weight of these
    for term in sorted(scored, key=lambda t: (-scored[t], -len(t.rstrip("*")), t)):
        body = term.rstrip("*")
        # No stem is added beside a shorter one that is as telling, nor one that says no more than one of its words.
        if body != term:
            if any(best.get(f"{body[:n]}*", 0) >= 0.95 * scored[term] for n in STEMS if n < len(body)) or inside.get(body, 0) >= scored[term]:
                continue
        best[term] = scored[term]
        for n in range(1, len(body) + 1):
            inside[body[:n]] = max(inside.get(body[:n], 0), scored[term])
    return best


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Newton steps on the bounded sample's features; the first number is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    b[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = ridge * np.eye(len(b))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def sketched(df: DataFrame) -> DataFrame:
    """Append ``sketch``, the least hash of the text's five-word shingles: equal for most near copies."""

    def start():
        shingle = Shingler(5)

        def step(texts):
            made = [shingle(t) for t in texts]
            return [[int(s[0].view(np.int64)) if len(s) else 0 for s in made]]

        return step

    return with_columns_in_arrow(df, ["text"], [T.StructField("sketch", T.LongType())], start)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from labelled rows that are not held out.

    At most POSITIVES and NEGATIVES rows, the first by hash of the key, are used; their texts stay on the executors.
    Terms are counted and their odds compared there, near copies once; the terms that tell are brought to the driver, all of them. The scorer
    is fitted by cross-fitting: each half's features come from the lexicon of the other half, so a chance term isn't
    taken at its word; the final lexicon uses both halves, and the intercept is set back to the labels' true ratio.
    Without rows of both classes the model scores a constant.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    usable = usable.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    totals = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    if len(totals) < 2:
        return Model(bias=math.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5)))
    sample = None
    for y, bound in ((1, POSITIVES), (0, NEGATIVES)):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(bound)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(sample), "k")  # at most POSITIVES + NEGATIVES keys
    rows = materialise(sketched(joined.repartition(F.xxhash64("k"))).withColumn("half", F.pmod(F.xxhash64("sketch"), F.lit(2)).cast("int")))
    # Near copies count once, and are in one half.
    single = materialise(rows.groupBy("sketch", "y", "half").agg(F.min("text").alias("text")))
    sizes = {(r.half, r.y): r["count"] for r in single.groupBy("half", "y").count().collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t, h, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seen.update((2 * y + h, x) for x in terms_of(words_of(t)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in seen], pa.int32()), pa.array([x for _, x in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["k", "term", "n"],
            )

    # Column k of four: clean and toxic documents of the first half, and of the second.
    terms = single.select("text", "half", "y").mapInArrow(counted, "k int, term string, n long")
    sums = terms.groupBy("term").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    choices = [(0,), (1,), (0, 1)]
    odds = [
        lower_odds_of(sum(F.col(f"n{2 + h}") for h in c), sum(F.col(f"n{h}") for h in c), sum(sizes.get((h, 1), 0) for h in c), sum(sizes.get((h, 0), 0) for h in c))
        for c in choices
    ]
    telling = sums.where((F.col("n2") + F.col("n3") >= 2) & (F.greatest(*odds) >= LEAST_ODDS - 1e-9)).collect()

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        both = {r.term: (sum(r[f"n{2 + h}"] for h in halves), sum(r[f"n{h}"] for h in halves)) for r in telling}
        return lexicon_from(both, sum(sizes.get((h, 1), 0) for h in halves), sum(sizes.get((h, 0), 0) for h in halves))

    other = spark.sparkContext.broadcast({0: lexicon((1,)), 1: lexicon((0,))})
    fields = [T.StructField("x", T.ArrayType(T.DoubleType()))]

    def start():
        built = {h: Lexicon(w) for h, w in other.value.items()}
        return lambda texts_, halves: [[features(*hits(built[h], t)) for t, h in zip(texts_, halves)]]

    fitted = with_columns_in_arrow(rows.select("text", "half", "y"), ["text", "half"], fields, start).select("x", "y").collect()
    x, y = np.array([r.x for r in fitted]), np.array([float(r.y) for r in fitted])
    if len(set(y)) < 2:
        return Model(bias=math.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5)))
    b = fit_logistic(x, y)
    shift = math.log(totals[1] / totals[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(lexicon((0, 1)), float(b[0] + shift), [float(v) for v in b[1:]])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append toxicity (0 to 1) and toxic_spans (start, end in code points, weight, edits, quoted) to ``docs``.

    One pass without a shuffle; the lexicon that is broadcast is bounded by the words of the labelled rows learned from. Null and empty texts get the
    score of a text without any term, repeated rows score alike, input columns named like an output are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("weight", T.DoubleType()),
            T.StructField("edits", T.IntegerType()),
            T.StructField("quoted", T.BooleanType()),
        ]
    )
    fields = [T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(span))]

    def start():
        own = sent.value
        lexicon = Lexicon(own.weights)

        def step(texts):
            scores, spans = [], []
            for t in texts:
                found, n = hits(lexicon, t)
                z = own.bias + sum(a * b for a, b in zip(own.slopes, features(found, n)))
                scores.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
                spans.append([{"start": h[1], "end": h[2], "weight": h[3], "edits": h[4], "quoted": h[5]} for h in found])
            return [scores, spans]

        return step

    return with_columns_in_arrow(docs, [text], fields, start)
