"""Text signals definable in plain SQL (K0); the characters of a text are counted in one pass over its bytes."""

from __future__ import annotations

from string import ascii_letters, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import ratio

# Signal -> direction of its reference score.
SIGNALS = {
    "unique_share": "positive",
    "mean_word_length": "positive",
    "vowel_share": "positive",
    "sentence_rate": "positive",
    "letter_share": "positive",
    "comma_share": "positive",
    "upper_share": "typical",
    "digit_share": "typical",
    "symbol_share": "reverse",
    "punct_share": "typical",
    "repeat_line_share": "reverse",
    "line_rate": "typical",
}
FACETS = {
    "content": ["unique_share", "mean_word_length", "vowel_share"],
    "language": ["sentence_rate", "letter_share", "comma_share"],
    "cleanliness": ["upper_share", "digit_share", "symbol_share"],
    "form": ["punct_share", "repeat_line_share", "line_rate"],
}
SEMANTIC = FACETS["content"] + FACETS["language"]
MORPHOLOGY = FACETS["cleanliness"] + FACETS["form"]


#: Classes of characters that signals count. All are ASCII, so their bytes are counted.
CLASSES = {
    "stops": ".!?",
    "vowels": "aeiouAEIOU",
    "letters": ascii_letters,
    "commas": ",",
    "uppers": ascii_uppercase,
    "digits": digits,
    "symbols": "#*=<>@/",
    "puncts": ",;:.!?",
}
_COUNTS = ["words", "lines", "unique_words", "unique_lines", *CLASSES]
_MEMBERS = np.array([[chr(b) in chars for chars in CLASSES.values()] for b in range(256)], np.int64)


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in _COUNTS]))
def _counted(texts: pa.Array) -> pa.Array:
    """Words, lines, their distinct numbers and the characters of each class; every text is read once."""
    raw = [t or b"" for t in texts.to_pylist()]
    bytes_seen = np.zeros((len(raw), 256), np.int64)
    words, lines = np.ones(len(raw), np.int64), np.ones(len(raw), np.int64)
    for i, t in enumerate(raw):
        bytes_seen[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        words[i], lines[i] = len(set(t.split(b" "))), len(set(t.split(b"\n")))
    columns = [bytes_seen[:, ord(" ")] + 1, bytes_seen[:, ord("\n")] + 1, words, lines, *(bytes_seen @ _MEMBERS).T]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], _COUNTS, mask=texts.is_null())


def text_signals(docs: DataFrame) -> DataFrame:
    """Append word, sentence and shape signals of `text`."""
    text = F.col("text")
    counted = docs.withColumn("_c", _counted(text.cast("binary")))
    c = {n: F.col("_c")[n] for n in _COUNTS}
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    wc = c["words"].cast("double")
    return counted.select(
        *docs.columns,
        wc.alias("word_count"),
        c["stops"].cast("double").alias("sentence_count"),
        (c["unique_words"] / wc).alias("unique_share"),
        ((F.length(text) - (wc - 1)) / wc).alias("mean_word_length"),
        ratio(c["vowels"], c["letters"]).alias("vowel_share"),
        (c["stops"] / wc).alias("sentence_rate"),
        (c["letters"] / n).alias("letter_share"),
        (c["commas"] / n).alias("comma_share"),
        (c["uppers"] / n).alias("upper_share"),
        (c["digits"] / n).alias("digit_share"),
        (c["symbols"] / n).alias("symbol_share"),
        (c["puncts"] / n).alias("punct_share"),
        (1 - c["unique_lines"] / c["lines"]).alias("repeat_line_share"),
        (c["lines"] / wc).alias("line_rate"),
    )
