"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a bounded sample (``sample_rows`` documents,
the first ``sample_chars`` characters of each); the rules then run in the order of rejections per
second, and a document's first rejection ends its cascade. The order changes only the time taken:
the verdict is the conjunction of all rules, over the whole text.

Defined results: a null text counts as no words and is rejected (fewer than ten words); so is an
empty one. Null or repeated ids are carried through; each input row gives one output row. Extra
columns are ignored. An empty table gives an empty result. Rules that tie in rejections per second run in
the order in which they are listed. A text of any length is judged whole, in memory that follows its
own length.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.common import WHITE, map_batches, table, words

SYMBOLS = "#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))


class Document:
    """A text whose figures are computed when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and how many of them equal an earlier one."""
        full = [x for x in self.text.split("\n") if x.strip(WHITE)]
        return len(full), len(full) - len(set(full))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def case(self) -> tuple[int, int]:
        """ASCII upper-case letters and ASCII letters."""
        raw = self.text.encode()
        upper = len(raw) - len(raw.translate(None, UPPER))
        return upper, upper + len(raw) - len(raw.translate(None, LOWER))


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def repeat_words(tokens: list[bytes], width: int = 5) -> int:
    """Words within windows of ``width`` words that the text holds twice or more, exactly."""
    n = len(tokens)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, n)
    if len(seen) == n:
        return 0
    k = len(seen)
    if k**width < 2**63:
        key = ids[: n - width + 1].copy()
        for j in range(1, width):
            key = key * k + ids[j : n - width + 1 + j]
    else:  # widen by one word at a time; after each, the keys are numbered anew and stay small
        key = ids
        for j in range(1, width):
            key = _dense(key[: n - j] * k + ids[j:])
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    covered = np.zeros(n, bool)
    for j in range(width):
        covered[j : n - width + 1 + j] |= hit
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]
    seconds: float = 0.0
    rejection: float = 0.0

    @property
    def gain(self) -> float:
        return self.rejection / max(self.seconds, 1e-9)


def _base_words(d: Document) -> bool:
    return d.n_words < 10


def _base_repeats(d: Document) -> bool:
    return 100 * d.n_repeat_words > 20 * d.n_words


def _symbols(d: Document) -> bool:
    return 10 * d.n_symbols > d.n_words


def _capitals(d: Document) -> bool:
    upper, letters = d.case
    return 100 * upper > 40 * letters


def _lines(d: Document) -> bool:
    lines, repeated = d.lines
    return 2 * repeated > lines


def _word_length(d: Document) -> bool:
    return not 2 * d.n_words <= d.word_chars <= 25 * d.n_words


def _broken(d: Document) -> bool:
    return 100 * d.text.count("�") > len(d.text)


#: Fewer than 10 words; over 20 % of words in repeated 5-word windows; over one symbol to ten
#: words; over 40 % capitals; over half of the lines repeated; words of under 2 or over 25
#: characters on average; over 1 % replacement characters.
RULES = tuple(Rule(k, f) for k, f in (("words", _base_words), ("repeats", _base_repeats), ("symbols", _symbols), ("capitals", _capitals), ("lines", _lines), ("word_length", _word_length), ("broken", _broken)))


def plan_cascade(sample: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejection per cost on the sample, most first; ties by their given order."""
    if not sample:
        return rules
    timed = []
    for rule in rules:
        began, hits = time.perf_counter(), 0
        for text in sample:  # a fresh document each time: the cost holds the figures it needs
            hits += rule.rejects(Document(text))
        timed.append(Rule(rule.name, rule.rejects, (time.perf_counter() - began) / len(sample), hits / len(sample)))
    return tuple(sorted(timed, key=lambda r: (-r.gain, r.seconds if not r.rejection else 0)))


def sample_texts(docs: DataFrame, id_col: str, text_col: str, rows: int = 256, chars: int = 20_000) -> list[str | None]:
    """About ``rows`` texts (twice as many at most), of ``chars`` characters, by a hash of the id below the share that they are of all rows; they serve to order the rules only. Each task passes its own share on, however many tasks there are."""
    share = min(1.0, rows / max(1, docs.count()))
    part = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) / float(1 << 40)
    return [r.t for r in docs.where(part < share).select(F.substring(text_col, 1, chars).alias("t")).limit(2 * rows).collect()]


def keep(text: str | None, cascade: tuple[Rule, ...]) -> bool:
    doc = Document(text)
    return not any(rule.rejects(doc) for rule in cascade)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, cascade: tuple[Rule, ...] | None = None) -> DataFrame:
    """Per row: the id, the base figures, ``base_failed`` and ``kept``."""
    order = cascade or plan_cascade(sample_texts(docs, id_col, text_col), rules)
    base = {"words", "repeats"}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            d = Document(text)
            failed = _base_words(d) or _base_repeats(d)
            kept = not failed and not any(r.rejects(d) for r in order if r.name not in base)
            out.append((d.n_words, d.word_chars, d.n_symbols, d.lines[1], d.n_repeat_words, failed, kept))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])],
            names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), each, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass the cascade, all their columns unchanged. Here no figure is asked for, so the cascade ends at a row's first rejection."""
    order = plan_cascade(sample_texts(docs, id_col, text_col), rules)
    at = docs.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([keep(t, order) for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, each, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), pos AS (
  SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5
), win AS (
  SELECT r, i, ws[i:i + 4] AS g FROM pos
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r
), f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
         length(t) - length(replace(t, chr(65533), '')) AS bad, length(t) AS chars
  FROM w LEFT JOIN rep ON w.r = rep.r
), g AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * up > 40 * letters OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 100 * bad > chars) AS kept
FROM g
"""
