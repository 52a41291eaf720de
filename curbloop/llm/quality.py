"""Quality rules as one Spark projection, without user functions.

Defined results: a null or empty text has no words, fails the base rule and is not kept. Equal rows get equal verdicts; other
columns are kept, and those named like a metric or verdict are replaced.
"""
from pyspark.sql import Column, DataFrame, functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """the of and to in that is was for it with as be by on this are from
le la les des de un une et du en que qui dans pour sur par est au
der die das und den von zu mit ein eine für auf im nicht ist des sich dem
el los las que y una por con para del se no su es lo como""".split()

#: Rule: (name, metric, lower limit, upper limit); a limit of None is open. A text is kept if every metric is within its limits.
RULES = [
    ("enough_words", "n_words", 20, None),
    ("not_too_many_words", "n_words", None, 1_000_000),
    ("word_length", "mean_word_chars", 2.5, 12.0),
    ("few_symbols", "symbols_per_word", None, 0.25),
    ("stop_words", "stop_word_ratio", 0.03, None),
    ("few_upper_case", "upper_ratio", None, 0.5),
    ("mostly_letters", "letter_ratio", 0.6, None),
    ("few_repeated_lines", "dup_line_ratio", None, 0.4),
    ("few_repeated_words", "repeat_word_ratio", None, 0.3),
    ("few_bullet_lines", "bullet_line_ratio", None, 0.9),
    ("few_ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
]
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


def _count_of(text: Column, others: str) -> Column:
    """Number of code points left when runs of the class ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. ``hashes``: (hash, start) of each window, ascending."""
    same = F.filter(hashes, lambda w, i: (F.get(hashes, i - 1)["h"] == w["h"]) | (F.get(hashes, i + 1)["h"] == w["h"]))
    starts = F.array_sort(F.transform(same, lambda w: w["at"]))
    steps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))),
                       lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda total, s: total + s).cast("long")


def measure(docs: DataFrame, text="text") -> DataFrame:
    """Add the counts and ratios the rules use. Windows are compared by a 64-bit hash of the hashes of their words."""
    names = ["word_hashes", "windows", "whole", "words", "lines"]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("whole", whole)
    rows = rows.withColumn("words", F.filter(F.split("whole", SPACE), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("whole", "\n"), lambda line: line.rlike(WORD)))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "word_chars": _count_of(F.col("whole"), SPACE),
        "n_symbols": _count_of(F.col("whole"), r"[^#*$%&|<>]+"),
        "n_letters": _count_of(F.col("whole"), r"[^\p{L}]+"),
        "n_upper": _count_of(F.col("whole"), r"[^\p{Lu}]+"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_bullets": F.size(F.filter("lines", lambda line: line.rlike(r"\A\s*[-*•]\s"))).cast("long"),
        "n_ellipses": F.size(F.filter("lines", lambda line: line.rlike(r"(\.\.\.|…)\s*\z"))).cast("long"),
        "n_stop_words": F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
    })
    parts = [lambda i, k=k: F.get(F.col("word_hashes"), i + k) for k in range(WINDOW)]
    rows = rows.withColumn("windows", F.when(F.col("n_words") > WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n_words") - WINDOW, F.lit(0)).cast("int")),
        lambda i: F.xxhash64(*[p(i) for p in parts]))).otherwise(F.array().cast("array<long>")))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    rows = rows.withColumn("ordered", F.when(repeated, ordered))
    rows = rows.withColumn("n_repeat_words", F.when(repeated, _repeat_words(F.col("ordered"))).otherwise(F.lit(0)).cast("long"))
    per_word, per_line = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return rows.withColumns({
        "mean_word_chars": F.col("word_chars") / per_word,
        "symbols_per_word": F.col("n_symbols") / per_word,
        "stop_word_ratio": F.col("n_stop_words") / per_word,
        "letter_ratio": F.col("n_letters") / F.greatest("word_chars", F.lit(1)),
        "upper_ratio": F.col("n_upper") / F.greatest("n_letters", F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / per_line,
        "repeat_word_ratio": F.col("n_repeat_words") / per_word,
        "bullet_line_ratio": F.col("n_bullets") / per_line,
        "ellipsis_line_ratio": F.col("n_ellipses") / per_line,
    }).drop(*names, "ordered")


def compile_rules(rules=None) -> tuple[Column, Column]:
    """The threshold table as two expressions: the names of the broken rules, and whether there is none."""
    broken = []
    for name, metric, low, high in RULES if rules is None else rules:
        fails = F.lit(False)
        if low is not None:
            fails = fails | (F.col(metric) < low)
        if high is not None:
            fails = fails | (F.col(metric) > high)
        broken.append(F.when(fails, F.lit(name)))
    names = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    passed = F.lit(True)
    for b in broken:
        passed = passed & b.isNull()
    return names, passed


def judge(docs: DataFrame, text="text", rules=None) -> DataFrame:
    """Measures, ``base_failed``, ``broken_rules`` and ``kept`` for every row."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    names, passed = compile_rules(rules)
    return measure(docs, text).withColumns({"base_failed": failed, "broken_rules": names}).withColumn("kept", ~failed & passed)
