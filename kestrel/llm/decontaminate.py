"""Benchmark decontamination with one Aho-Corasick automaton (operator 1)."""

from __future__ import annotations

import bisect
import re
import uuid
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import with_columns_in_arrow

#: Bytes of benchmark text that one automaton may hold. It takes up to 90 times its text (measured: 85 for 2 MB of random words, far
#: less where items share words), so this bounds a worker to about 540 MB. Test sets are smaller and do not grow with the corpus.
AUTOMATON_BYTES = 6 << 20
#: Words over UTF-8 bytes once A-Z are lower: digits, a-z and every byte outside ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def build(items: list[tuple[object, str]], window: int):
    """(automaton over word numbers, word -> number, item ids in string order of the id, windows). A pattern's value is its place in
    windows, which hold (length, numbers of the items it occurs in); windows of the same items share one list."""
    import ahocorasick

    items = sorted(((str(i), t) for i, t in items if i is not None), key=lambda x: x[0])
    numbers: dict[bytes, int] = {}
    names = sorted({i for i, _ in items})
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    windows: list[tuple[int, tuple[int, ...]]] = []
    shared: dict[tuple, tuple] = {}
    for i, text in items:
        own = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words_of(text))
        n = bisect.bisect_left(names, i)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            pattern = own[k : k + window]
            at = machine.get(pattern, -1)
            if at < 0:
                machine.add_word(pattern, len(windows))
                windows.append(shared.setdefault((len(pattern), (n,)), (len(pattern), (n,))))
            elif windows[at][1][-1] != n:  # items come in order of their numbers
                longer = (len(pattern), (*windows[at][1], n))
                windows[at] = shared.setdefault(longer, longer)
    if windows:
        machine.make_automaton()
    return machine if windows else None, numbers, names, windows


#: The automaton that this worker built last, by the name of its block: later tasks of the stage take it as it is.
_BUILT: dict[str, tuple] = {}


def built(name: str, sent, window: int):
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build(sent.value, window)
    return _BUILT[name]


def scan(machine, numbers: dict[bytes, int], windows: list[tuple[int, tuple[int, ...]]], text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, merged hit word ranges, items found) of one text, in one pass over it."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    found: set[int] = set()
    if machine is None:
        return len(words), spans, found
    get, at = numbers.get, 0
    ids = [get(w, 0) for w in words]
    # A word that no item has breaks every match, so each run of known words is scanned by itself.
    for known, run in groupby(ids, bool):
        run = tuple(run)
        if known:
            for end, which in machine.iter(run):
                length, items = windows[which]
                first, last = at + end - length + 1, at + end + 1
                found.update(items)
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, last))
        at += len(run)
    return len(words), spans, found


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point ranges of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    out, byte, char = [], 0, 0
    for first, last in spans:
        ends = []
        for b in (places[first][0], places[last - 1][1]):
            char += len(raw[byte:b].decode("utf-8", "surrogatepass"))
            byte = b
            ends.append(char)
        out.append((ends[0], ends[1]))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    window: int = 13,
    share: int = 20,
    max_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Append n_words, n_hit, items, hit_spans and contaminated to ``docs``; no shuffle.

    A document word is hit when it lies in an occurrence of any ``window`` consecutive words of an item (a shorter
    item counts as one window); ``contaminated`` holds from one hit word in ``share`` on. ``items`` are the ids of the
    items found, as strings in order; ``hit_spans`` are ranges of the original text in code points.

    The benchmark (item_id, text) is read on the driver and its automaton broadcast, after its size is checked against
    ``max_bytes``: beyond it the benchmark is cut into blocks of that size and the documents pass through one automaton
    after the other. Null texts have no words, null items no windows, items repeated under one id count once, an empty
    benchmark hits nothing, and input columns named like an output are replaced.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    # A prefix sum over the item sizes would need one task; hashing items into enough blocks keeps this distributed.
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-total // max_bytes))
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("hit_words", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
    out = docs
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.select("item_id", "text").collect()])
        earlier = ["hit_words", "items"] if block else []

        def start(name=uuid.uuid4().hex, sent=sent, earlier=bool(earlier)):
            machine, numbers, names, windows = built(name, sent, window)

            def step(texts, words_before=None, items_before=None):
                made = [[] for _ in fields]
                for k, t in enumerate(texts):
                    n, spans, found = scan(machine, numbers, windows, t)
                    items = [names[i] for i in sorted(found)]
                    if earlier:
                        items = sorted({*items, *items_before[k]})
                        merged: list[tuple[int, int]] = []
                        for a, b in sorted([*spans, *map(tuple, words_before[k])]):
                            if merged and merged[-1][1] >= a:
                                a, b = merged[-1][0], max(b, merged.pop()[1])
                            merged.append((a, b))
                        spans = merged
                    hit = sum(b - a for a, b in spans)
                    places = [{"start": a, "end": b} for a, b in offsets(t, spans)] if spans else []
                    for column, value in zip(made, (n, hit, items, places, hit > 0 and share * hit >= n, [list(s) for s in spans])):
                        column.append(value)
                return made

            return step

        if block:
            out = out.withColumnsRenamed({"hit_words": "_hit_words", "items": "_items"})
            out = with_columns_in_arrow(out, [text, "_hit_words", "_items"], fields, start).drop("_hit_words", "_items")
        else:
            out = with_columns_in_arrow(out, [text], fields, start)
    return out.drop("hit_words")
