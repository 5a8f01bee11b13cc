"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule bounds one count by a percentage of another (or a count by itself), so every test is one of integers. The
measures are built from Spark's string and array functions alone; each long array is made once, in a projection below
the one that reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm._common import table

#: Function words of the corpus languages; a text of running prose in one of them is full of these.
STOP_WORDS = (
    "the of and to in is that it for on with as was be by this are from at or an not you have "
    "der die und den das von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des et un une du en que qui dans pour par sur au aux il elle ne pas est son ce se avec plus "
    "el los las y una del que por con para su al lo como más se no sus o pero fue"
).split()

_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Rejects where 100 * measure is below low * per or above high * per. per None: bounds on measure itself."""

    name: str
    measure: str
    per: str | None = None
    low: int | None = None
    high: int | None = None

    def sql(self) -> str:
        """The same text is SQL for Spark and for an oracle: true where the rule rejects."""
        left = self.measure if self.per is None else f"100 * {self.measure}"
        tests = [] if self.low is None else [f"{left} < {self.low}" + ("" if self.per is None else f" * {self.per}")]
        tests += [] if self.high is None else [f"{left} > {self.high}" + ("" if self.per is None else f" * {self.per}")]
        return "(" + " OR ".join(tests) + ")"


BASE = (
    Rule("too_short", "n_words", low=50),
    Rule("repeats_itself", "n_repeat_words", per="n_words", high=50),
)

RULES = (
    Rule("word_length", "word_chars", per="n_words", low=200, high=1500),
    Rule("symbols_to_words", "n_symbols", per="n_words", high=20),
    Rule("stop_words", "n_stop_words", per="n_words", low=3),
    Rule("repeated_lines", "n_dup_lines", per="n_lines", high=40),
)


def measures(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """carry columns, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words (long).

    A null text has no words and no lines. Words are cut at the space and at 0x09 to 0x0D; lines at \\n, and only lines
    with a word count. n_repeat_words counts words in a window of three words that the text holds twice or more;
    windows are compared by a 64-bit hash. Every other column is dropped, so names can't clash.
    """
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    held = [F.col(f"`{c}`") for c in carry]
    df = docs.select(*held, t.alias("__t"))
    words = F.filter(F.split(F.translate("__t", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    df = df.select(*held, "__t", words.alias("__w"), lines.alias("__l"))
    df = df.select(
        *held,
        "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__w", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    df = df.select(*held, *counts, F.transform("__w", lambda w: F.xxhash64(w)).alias("__v"))
    window = F.transform("__v", lambda x, i: F.xxhash64(x, F.get("__v", i + 1), F.get("__v", i + 2)))
    df = df.select(*held, *counts, F.slice(window, 1, F.greatest(F.size("__v") - 2, F.lit(0))).alias("__g"))
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("__g")) < F.size("__g")
    pairs = F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*held, *counts, F.when(repeats, pairs).alias("__s"))
    twice = F.filter(
        F.transform(
            "__s",
            lambda s, k: F.when(
                (F.get("__s", k - 1)["h"] == s["h"]) | (F.get("__s", k + 1)["h"] == s["h"]), s["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    df = df.select(*held, *counts, F.sort_array(twice).alias("__at"))
    # a window covers three words, or as many as there are up to the next repeated window
    covered = F.aggregate(
        F.transform("__at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    df = df.select(*held, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # A filter isn't pushed below a generator: else it would take the arrays along and make them for every element.
    return df.select(*held, F.inline(F.array(F.struct(*counts, "n_repeat_words"))))


def any_of(rules: tuple[Rule, ...]) -> Column:
    return F.expr(" OR ".join(r.sql() for r in rules)) if rules else F.lit(False)


def apply_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple[Rule, ...] = BASE,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per input row: id, the measures, base_failed, failed_rules (names in table order), kept.

    An empty or null text fails the base. Ids may repeat or be null; each row is judged alone. No shuffle.
    """
    df = measures(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")), carry=("__id",))
    names = [F.when(F.expr(r.sql()), F.lit(r.name)) for r in (*base, *rules)]
    df = df.withColumns({"base_failed": any_of(base), "failed_rules": F.array_compact(F.array(*names))})
    return df.withColumn("kept", ~F.col("base_failed") & ~any_of(rules)).withColumnRenamed("__id", id_col)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_IN = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (
  SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM g),
rep AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g2 WHERE k > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ws, lambda x: x IN ({_IN})))::BIGINT AS n_stop_words,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({" OR ".join(r.sql() for r in BASE)}) AS base_failed,
       NOT ({" OR ".join(r.sql() for r in (*BASE, *RULES))}) AS kept
FROM m
"""
