"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for each document and stores the
measurements with one bit for each failed rule.  A policy is only a mask of
rules with a version, so a new policy, and the question what each of its rules
removes alone, are answered from the ledger by bitwise operations, without
reading a text again.

Null text counts as empty, and so fails the word count.  Repeated rows are
judged each on its own; null ids stay null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fxledger.llm import textops as tx

MEASURES = ("n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
            "n_repeat_words long, n_upper long, n_lower long")
REPEAT = 8
SYMBOLS = tx.table_of(b"#*$%&|<>")
UPPER, LOWER = tx.table_of(bytes(range(65, 91))), tx.table_of(bytes(range(97, 123)))


def _m(name: str) -> Column:
    return F.col(f"out.{name}")


def rules() -> dict[str, Column]:
    """Name -> condition of failure over the measurements; the position is the
    bit.  Integer arithmetic only, so no verdict depends on rounding."""
    return {
        "few_words": _m("n_words") < 20,
        "repeated_words": 100 * _m("n_repeat_words") > 30 * _m("n_words"),
        "symbols": 100 * _m("n_symbols") > 20 * _m("n_words"),
        "short_words": _m("word_chars") < 2 * _m("n_words"),
        "long_words": _m("word_chars") > 15 * _m("n_words"),
        "repeated_lines": (_m("n_lines") >= 4) & (2 * _m("n_dup_lines") > _m("n_lines")),
        "shouting": 100 * _m("n_upper") > 60 * (_m("n_upper") + _m("n_lower")),
    }


def bit(name: str) -> int:
    return 1 << list(rules()).index(name)


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it applies."""

    version: str
    names: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(n) for n in self.names)


BASE = Policy("base-1", ("few_words", "repeated_words"))
DEFAULT = Policy("web-1", ("few_words", "repeated_words", "symbols", "short_words", "long_words",
                           "repeated_lines", "shouting"))


def measure(text: pa.Array) -> list[np.ndarray]:
    """The measurements of each text, in the order of ``MEASURES``."""
    parts = []
    for a, b, buf, off in tx.slabs(text):
        n, doc_salt = b - a, tx.salt(np.arange(b - a))
        hashed = tx.Prefix(buf)
        w0, w1, wd = tx.words(buf, off)
        count = np.bincount(wd, minlength=n)
        outside = tx.IS_SPACE[buf]
        chars = tx.per_doc(~outside & ((buf & 0xC0) != 0x80), off)
        # lines with a word, equal to an earlier one of the document
        cut = np.flatnonzero(buf == 10)
        l0 = np.sort(np.concatenate([off[:-1], cut + 1]))
        ld = np.searchsorted(off, l0, "right") - 1
        ends = np.sort(np.concatenate([off[1:], cut]))
        # a newline that ends a document also starts an empty line there
        tail = np.zeros(len(l0), dtype=bool)
        if len(l0) == len(ends):
            filled = np.zeros(len(buf) + 1, dtype=np.int64)
            np.cumsum(~outside, out=filled[1:])
            tail = (ends > l0) & (filled[np.maximum(ends, l0)] > filled[l0])
        l0, l1, ld = l0[tail], ends[tail], ld[tail]
        n_lines = np.bincount(ld, minlength=n)
        keys = np.unique(np.rec.fromarrays([ld, hashed.of(l0, l1)])) if len(l0) else None
        distinct = np.bincount(keys.f0, minlength=n) if keys is not None else np.zeros(n, np.int64)
        # words in windows that occur twice or more in the document
        g = tx.grams(hashed.of(w0, w1), REPEAT)
        at = np.flatnonzero(tx.within(wd, REPEAT))
        key = g[at] ^ doc_salt[wd[at]]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeated = np.bincount(wd[tx.cover(at[twice], REPEAT, len(w0))], minlength=n)
        parts.append([count, chars, tx.per_doc(SYMBOLS[buf], off), n_lines, n_lines - distinct,
                      repeated, tx.per_doc(UPPER[buf], off), tx.per_doc(LOWER[buf], off)])
    if not parts:
        return [np.zeros(0, np.int64)] * 8
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)]


def _judged(docs: DataFrame) -> DataFrame:
    judged = tx.rowwise(docs, measure, "struct<" + MEASURES.replace(" long", ":long") + ">")
    bits = F.lit(0).cast("long")
    for name, failed in rules().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(bit(name))).otherwise(F.lit(0)).cast("long"))
    return judged.withColumn("fail_bits", bits)


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, the measurements, ``fail_bits``."""
    return _judged(docs.select("doc_id", "text")).select("doc.doc_id", "out.*", "fail_bits")


def apply_policy(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Add ``policy_version``, ``base_failed`` and ``kept`` to a ledger."""
    return (led.withColumn("policy_version", F.lit(policy.version))
            .withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0)
            .withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask | BASE.mask)) == 0))


def ablation(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: the documents that fail it, and those that
    only it removes (what the policy would keep without it).

    The ledger first collapses to one row for each pattern of bits (at most
    two to the number of rules), so nothing else is shuffled.
    """
    patterns = (led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits"))
                .agg(F.count(F.lit(1)).alias("n")))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bit(n)).cast("long").alias("bit"))
                               for n in policy.names])).alias("r")
    return (patterns.select("bits", "n", each)
            .groupBy("r.rule")
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0))
                 .alias("failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0))
                 .alias("only_this_rule"))
            .withColumn("policy_version", F.lit(policy.version)))


def keep(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The documents, with their own columns, that the policy keeps (no shuffle)."""
    return (_judged(docs)
            .where(F.col("fail_bits").bitwiseAND(F.lit(policy.mask | BASE.mask)) == 0)
            .select("doc.*"))
