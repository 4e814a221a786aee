"""Removal of repeated word passages by suffix automata of reference shards.

A window of ``WINDOW`` words whose words also start earlier (in a document of
smaller id, or earlier in the same one) is covered, and covered words go, so
the first copy of a passage stays.  Windows are judged on the input.

The segments that may repeat (see ``repeats``) are dealt to reference shards by
anchor.  A shard keeps a suffix automaton over the words of the segments it has
seen, in the order of their first copies; the next segment is streamed through
it for its matching statistics (the longest suffix at each word that occurs in
the reference), and wherever these reach the window length, a window is
covered.  Then the segment joins the reference.  The automaton of a shard goes
where its segments go, instead of to every task: sending all automata to all
documents would grow with the square of the corpus.  A shard is closed after
``SHARD_WORDS`` words, between two anchors, so its memory is bounded.

Null and empty texts have no words.  See ``repeats`` for repeated and null ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fxledger.llm import repeats, textops as tx
from fxledger.llm.memory import freed

WINDOW = 20
ANCHOR = 6
SHARD_WORDS = 100_000
UNIT = repeats.Unit(True, WINDOW, ANCHOR)


class Automaton:
    """A generalised suffix automaton over integers; 0 is the root."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, word: list[int]) -> None:
        last = 0
        for ch in word:
            last = self._extend(last, ch)

    def _clone(self, p: int, q: int, ch: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and nxt[p].get(ch) == q:
            nxt[p][ch] = c
            p = link[p]
        link[q] = c
        return c

    def _extend(self, last: int, ch: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(ch)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, q, ch)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0:
            q = nxt[p].get(ch)
            if q is not None:
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, ch)
                break
            nxt[p][ch] = cur
            p = link[p]
        return cur

    def statistics(self, word: list[int]) -> Iterator[int]:
        """At each item, the length of the longest suffix that occurs in the reference."""
        state = size = 0
        nxt, link, length = self.next, self.link, self.length
        for ch in word:
            while state and ch not in nxt[state]:
                state = link[state]
                size = length[state]
            q = nxt[state].get(ch)
            if q is None:
                size = 0
            else:
                state, size = q, size + 1
            yield size


def match(rows: Iterator[tuple[int, int, bytes]], window: int = WINDOW,
          shard_words: int = SHARD_WORDS) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(content, covered window ranges) of the segments that earlier ones cover."""
    shard, numbers, size, anchor = Automaton(), {}, 0, None
    for h, content, text in rows:
        if h != anchor:
            if size > shard_words:
                shard, numbers, size = Automaton(), {}, 0
            anchor, fresh = h, True
        else:
            fresh = False
        word = [numbers.setdefault(w, len(numbers)) for w in text.split()]
        if not fresh:
            ranges: list[tuple[int, int]] = []
            for end, n in enumerate(shard.statistics(word)):
                if n >= window:
                    a = end - window + 1
                    if ranges and ranges[-1][1] == a:
                        ranges[-1] = (ranges[-1][0], a + 1)
                    else:
                        ranges.append((a, a + 1))
            if ranges:
                yield content, ranges
        shard.add(word)
        size += len(word)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, z, found: see ``repeats.spans``."""
    return repeats.spans(docs, UNIT, match, first_stays=True)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (the kept words, joined by a space)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                text = repeats.texts(b)
                gone = repeats.removed(text, b.column("found").to_pylist(), UNIT, True)
                rows = []
                for raw, (items, _) in zip(text.to_pylist(), gone, strict=True):
                    words, kept, end = raw.split(), [], 0
                    for p, q in items:
                        kept += words[end:p]
                        end = q
                    kept += words[end:]
                    rows.append((len(words), len(words) - len(kept),
                                 hashlib.sha256(b" ".join(kept)).hexdigest()))
                n, r, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(freed(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, with their own columns.
    Texts without one stay as they are; ``n_chars``, if there, follows the text.
    A document of which nothing is left stays, with an empty text."""
    v = repeats.verdicts(docs, UNIT, match, True).withColumnRenamed("key", "vkey")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       repeats.key(docs).alias("key"))
    rows = rows.join(v, F.col("key") == F.col("vkey"), "left").select("doc", "found")
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                doc = b.column(0)
                text = pa.array([(t or "").encode() for t in doc.field("text").to_pylist()],
                                pa.large_binary())
                gone = repeats.removed(text, b.column(1).to_pylist(), UNIT, True)
                out = pa.array([{"bytes": [{"a": p, "b": q} for p, q in r]} for _, r in gone],
                               pa.struct([("bytes", repeats._RANGES)]))
                yield pa.RecordBatch.from_arrays([doc, out], ["doc", "out"])

    kind = rows.select("doc", F.lit(None).cast(f"struct<bytes:{repeats.RANGES}>").alias("out")).schema
    return tx.cut_spans(rows.mapInArrow(freed(run), kind), docs.columns)

