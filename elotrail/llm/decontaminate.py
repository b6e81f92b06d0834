"""Operator 10: benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (A-Z lower-cased; runs of a-z, 0-9 and characters
above ASCII).  A *window* is ``WINDOW`` consecutive words of a benchmark item, or all
of a shorter item.  Each benchmark word gets a code of ``digits`` characters, every
digit from an alphabet of its own, so the automaton's nodes stay narrow and no
pattern can match across word bounds; all other words get the zero code.  A text is
then one string of codes, scanned once for all windows of all items.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

WINDOW = 10
BASE = 64
#: UTF-8 bytes of benchmark text in one automaton (a few hundred times that in memory at
#: worst); a larger benchmark is dealt over several, each scanned by tasks of its own
BLOCK_BYTES = 4 << 20
#: bytes to word characters (A-Z lower-cased) or a space
WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32
              for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split()


@dataclass
class Hits:
    """What an automaton finds in one text."""
    n_words: int
    runs: list[tuple[int, int]]  # first and last hit word of each run of hit words
    items: list[str]             # ids of the items of all windows found


class Automaton:
    """All windows of (item_id, text) pairs; null texts and items without words have none."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick
        of = [(i, words_of(t)) for i, t in items if t]
        vocabulary = sorted({w for _, ws in of for w in ws})
        self.digits = 1
        while BASE ** self.digits < len(vocabulary):
            self.digits += 1
        self.zero = "\0" * self.digits
        self.codes = {w: "".join(chr(1 + d * BASE + n // BASE ** d % BASE)
                                 for d in range(self.digits)) for n, w in enumerate(vocabulary)}
        windows: dict[str, tuple[int, set[str]]] = {}
        for i, ws in of:
            size = min(window, len(ws))
            for k in range(len(ws) - size + 1 if ws else 0):
                code = "".join(self.codes[w] for w in ws[k:k + size])
                windows.setdefault(code, (size, set()))[1].add(i)
        self.tree = ahocorasick.Automaton()
        for code, found in windows.items():
            self.tree.add_word(code, found)
        if windows:
            self.tree.make_automaton()
        self.empty = not windows

    def scan(self, text: str) -> Hits:
        words = words_of(text)
        if self.empty or not words:
            return Hits(len(words), [], [])
        get, zero = self.codes.get, self.zero
        runs: list[tuple[int, int]] = []
        sets: dict[int, set[str]] = {}
        for end, (size, items) in self.tree.iter("".join([get(w, zero) for w in words])):
            last = end // self.digits
            first = last - size + 1
            while runs and runs[-1][1] >= first - 1:  # ends only grow
                first = min(first, runs.pop()[0])
            runs.append((first, last))
            sets[id(items)] = items
        return Hits(len(words), runs, sorted(set().union(*sets.values())))


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans (end exclusive) in the original text of runs of words, which come in
    order and apart; one pass over the text."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    out, left = [], iter(runs)
    a, b = next(left)
    chars = at = start = 0  # characters before byte ``at``
    for n, m in enumerate(_WORD.finditer(raw.translate(WORDS))):
        if n == a:
            chars, at = chars + len(raw[at:m.start()].decode("utf-8", "surrogatepass")), m.start()
            start = chars
        if n == b:
            chars, at = chars + len(raw[at:m.end()].decode("utf-8", "surrogatepass")), m.end()
            out.append((start, chars))
            a, b = next(left, (-1, -1))
            if b < 0:
                break
    return out


_last: tuple[str, Automaton] | None = None  # of this worker


def _automaton(name: str, items: list[tuple[str, str]], window: int) -> Automaton:
    global _last
    if _last is None or _last[0] != name:
        _last = None
        _last = (name, Automaton(items, window))
    return _last[1]


def _blocks(bench: DataFrame, item_id: str, text: str,
            block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """(item_id, text) pairs in lists of about ``block_bytes``, each sent to the tasks whole."""
    b = bench.filter(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    size = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, ceil(size / block_bytes))
    deal = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return ([tuple(r) for r in b.filter(deal == k).collect()] for k in range(n))


def find_benchmark(docs: DataFrame, bench: DataFrame, window: int = WINDOW,
                   doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", block_bytes: int = BLOCK_BYTES,
                   prefix: str = "") -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``spans`` (characters of the original) and ``items``, their
    names after ``prefix``.

    A narrow pass over the documents without a shuffle for a benchmark of one block;
    with more blocks each is scanned for itself, and the results of a (doc_id, text)
    are joined.  A null text has no words; null items count for nothing, and items
    that share an id are one; an empty benchmark hits nothing; repeated rows stay.
    Spans are those of the runs of hit words, whatever the number of blocks.
    The four columns replace ones of the same names."""
    d = docs.drop(*[f"{prefix}{c}" for c in ("n_words", "n_hit", "spans", "items")])
    found = [_scan(d.sparkSession, items, window, text_of(text))
             for items in _blocks(bench, item_id, item_text, block_bytes)]
    if len(found) == 1:
        d = d.withColumn("__h", found[0])
    else:
        key = [F.col(doc_id).alias("__d"), F.sha2(text_of(text), 256).alias("__t")]
        parts = [d.select(*key, f.alias("h")) for f in found]
        both = parts[0]
        for p in parts[1:]:
            both = both.union(p)
        each = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
        found_ = F.arrays_zip(F.col("h.runs").alias("run"), F.col("h.spans").alias("span"))
        h = both.groupBy("__d", "__t").agg(
            F.max("h.n_words").alias("n_words"), _merged(each(found_)).alias("found"),
            each("h.items").alias("items"))
        h = h.select("__d", "__t", F.struct(
            "n_words", F.col("found.run").alias("runs"), F.col("found.span").alias("spans"),
            "items").alias("__h"))
        d = (d.withColumn("__u", key[1]).join(
            h, F.col(doc_id).eqNullSafe(F.col("__d")) & (F.col("__u") == F.col("__t")))
            .drop("__d", "__t", "__u"))
    # runs come in order, and none meets another
    hit = F.aggregate("__h.runs", F.lit(0), lambda n, r: n + r.b - r.a + 1)
    return d.select(*[c for c in d.columns if c != "__h"], F.col("__h.n_words").alias(f"{prefix}n_words"),
                    hit.cast("long").alias(f"{prefix}n_hit"), F.col("__h.spans").alias(f"{prefix}spans"),
                    F.col("__h.items").alias(f"{prefix}items"))


def _merged(found: Column) -> Column:
    """Of sorted (run, span) pairs, those that overlap or adjoin in words put together."""
    # e: last word so far; done: runs that are over; open: the one that may go on
    kind = ("struct<e:int,done:array<struct<run:struct<a:int,b:int>,span:struct<a:int,b:int>>>,"
            "open:struct<run:struct<a:int,b:int>,span:struct<a:int,b:int>>>")
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def step(x: Column, f: Column) -> Column:
        o, meets = x["open"], f["run"]["a"] <= x["e"] + 1
        joined = F.struct(
            pair(o["run"]["a"], F.greatest(o["run"]["b"], f["run"]["b"])).alias("run"),
            pair(o["span"]["a"], F.greatest(o["span"]["b"], f["span"]["b"])).alias("span"))
        done = F.when(o.isNull() | meets, x["done"]).otherwise(F.concat(x["done"], F.array(o)))
        return F.struct(F.greatest(x["e"], f["run"]["b"]).alias("e"), done.alias("done"),
                        F.when(meets & o.isNotNull(), joined).otherwise(f).alias("open")).cast(kind)

    zero = F.struct(F.lit(-2).alias("e"), F.array().alias("done"), F.lit(None).alias("open")).cast(kind)
    return F.aggregate(found, zero, step, lambda x: F.when(x["open"].isNull(), x["done"]).otherwise(
        F.concat(x["done"], F.array(x["open"]))))


def _scan(spark: SparkSession, items: list, window: int, text: Column) -> Column:
    """What the automaton of ``items`` finds in ``text``, as a struct."""
    sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    kind = pa.struct([("n_words", pa.int64()), ("runs", pair), ("spans", pair),
                      ("items", pa.list_(pa.string()))])
    pairs = "array<struct<a:int,b:int>>"

    @F.arrow_udf(f"struct<n_words:bigint,runs:{pairs},spans:{pairs},items:array<string>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto = _automaton(name, sent.value, window)
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                h = auto.scan(t)
                out.append({"n_words": h.n_words, "items": h.items,
                            "runs": [{"a": a, "b": b} for a, b in h.runs],
                            "spans": [{"a": a, "b": b} for a, b in spans(t, h.runs)]})
            yield pa.array(out, kind)

    return scan(text)
