"""Quality rules: one table of thresholds compiled into one Spark projection, without user functions.

Every signal is a whole-text count. A rule compares `scale * signal` with `limit * base`, in whole numbers, so that
Spark and SQL agree on every row. Defined results: a null text has no words and fails the length rule; an empty
table gives an empty result; repeated rows are judged one by one; other columns are carried through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")

# Frequent function words of the four languages.
STOP_WORDS = tuple(
    "the of and to a in is it that for on with as are was be by this an or from at not have "
    "de la le et les des en un une que qui dans pour est au du par sur "
    "der die und das den von zu mit ist im auf für ein eine sich dem nicht auch es "
    "el los las del por para con se su al como más o y".split())


@dataclass(frozen=True)
class Rule:
    """The document is rejected when `scale * signal` is under `least * base` or over `most * base`."""

    name: str
    signal: str
    base: str | None
    scale: int
    least: int | None = None
    most: int | None = None

    def broken(self) -> str:
        left = f"{self.scale} * {self.signal}"
        right = f" * {self.base}" if self.base else ""
        sides = [f"{left} < {self.least}{right}"] if self.least is not None else []
        sides += [f"{left} > {self.most}{right}"] if self.most is not None else []
        return "(" + " or ".join(sides) + ")"


BASE_RULES = (
    Rule("length", "n_words", None, 1, least=20),
    Rule("repeated_words", "n_repeat_words", "n_words", 100, most=30),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", 10, least=20, most=150),
    Rule("symbols", "n_symbols", "n_words", 100, most=20),
    Rule("stop_words", "n_stop_words", "n_words", 100, least=4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 100, most=40),
)


def failed_sql(rules: tuple[Rule, ...]) -> str:
    """Rule table as one boolean SQL expression, valid in Spark and in DuckDB."""
    return "(" + " or ".join(r.broken() for r in rules) + ")"


def _covered(repeats: Column) -> Column:
    """Words under 8-word windows at the given ascending starts."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(repeats, start, lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + F.least(F.lit(WINDOW), i + WINDOW - s["end"])).alias("n")), lambda s: s["n"])


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` as `row`, with the signals; equal windows are found by a 64-bit hash within one text."""
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    split = docs.select(F.struct("*").alias("row")).select(
        "row", F.array_remove(F.split(body, BLANKS, -1), "").alias("w"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        F.length(F.regexp_replace(body, BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    hashed = split.select(
        "*", F.size("w").cast("long").alias("n_words"),
        F.expr(f"if(size(w) >= {WINDOW}, transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))), cast(array() as array<bigint>))").alias("h"))
    # Only texts with a repeated window sort theirs; neighbours in that order show the repeats.
    repeated = F.expr("""if(size(array_distinct(h)) = size(h), cast(array() as array<int>),
      transform(array(array_sort(transform(h, (v, i) -> struct(v, i)))), s -> array_sort(transform(
        filter(s, (x, j) -> (j > 0 and element_at(s, j).v = x.v) or (j < size(s) - 1 and element_at(s, j + 2).v = x.v)), x -> x.i)))[0])""")
    return hashed.select(
        "row", "n_words", "word_chars", "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _covered(repeated).alias("n_repeat_words"), F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row`, the signals, `base_failed` and `kept`."""
    return (signals(docs, text).withColumn("base_failed", F.expr(failed_sql(BASE_RULES)))
            .withColumn("kept", ~F.col("base_failed") & ~F.expr(failed_sql(RULES))))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns they came with.

    The row number keeps the filter above the signals: pushed below them, it would hold each signal's whole expression
    once for every use.
    """
    numbered = signals(docs, text).withColumn("number", F.monotonically_increasing_id())
    good = ~F.expr(failed_sql(BASE_RULES + RULES))
    return numbered.where(good & (F.col("number") >= 0)).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """Signals and verdict per document."""
    return judge(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SIGNALS_SQL = f"""
q_words as (select *, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from docs),
q_win as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as k from q_words, unnest(range(1, len(w) - {WINDOW - 2})) u(i)),
q_rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from q_win) where c > 1),
q_cov as (select doc_id, count(distinct i + o) as n from q_rep, unnest(range({WINDOW})) v(o) group by doc_id),
q_sig as (select q_words.* exclude (w, l), len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(q_cov.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
  len(list_filter(w, lambda x: lower(x) in ({_STOPS})))::bigint as n_stop_words
  from q_words left join q_cov on q_words.doc_id = q_cov.doc_id),
q_judged as (select *, {failed_sql(BASE_RULES)} as base_failed, not {failed_sql(BASE_RULES)} and not {failed_sql(RULES)} as kept from q_sig)"""
ORACLE_SQL = f"""with docs as (select * from documents), {SIGNALS_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed, kept from q_judged"""
