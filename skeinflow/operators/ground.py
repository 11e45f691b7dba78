"""Evidence tests: a sentence stays if one single piece of evidence carries it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.functions.text import sentences, stem_short


def content_stems(c: Column | str, stop: tuple[str, ...] = fixed.STEM5_STOP) -> Column:
    """Distinct stems of words of four letters or more that are not stop words."""
    words = F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~F.lower(w).isin(*stop)), stem_short))


def whole_sentence(s: Column) -> Column:
    """Neither cut off nor begun in the middle: a closing mark at the end, no lower-case letter at the start."""
    last = F.substring(s, -1, 1)
    return ~s.rlike("(?:…|\\.\\.\\.)\\s*$|^[a-z]") & last.isin(*fixed.SENTENCE_ENDS)


def numbers(s: Column, strict: bool = True) -> Column:
    """Numbers in a sentence; strict keeps a full stop that follows one."""
    found = F.regexp_extract_all(s, F.lit("[0-9][0-9,.]*"), F.lit(0))
    return found if strict else F.transform(found, lambda n: F.regexp_replace(n, "[.,]+$", ""))


def vetted(
    texts: DataFrame, evidence: DataFrame, key: str, text: str = "text", evidence_text: str = "evidence", share: float = fixed.GROUND_SHARE,
    short: int = fixed.GROUND_SHORT, strict: bool = True,
) -> DataFrame:
    """(key, at, sentence, kept): each sentence of each text in order.

    Kept are whole sentences with fewer than `short` stems, and those of which
    one piece of evidence of the same key holds `share` of the stems and every
    number. Sentences and evidence meet on the key only; evidence is reduced to
    its stems before the join. A text without evidence keeps its short sentences.
    """
    s = texts.select(key, F.posexplode(sentences(text)).alias("at", "sentence"))
    s = s.withColumns({"need": content_stems("sentence"), "numbers": numbers(F.col("sentence"), strict), "whole": whole_sentence(F.col("sentence"))})
    e = evidence.where(F.coalesce(evidence_text, F.lit("")) != "").select(key, F.col(evidence_text).alias("_e"), content_stems(evidence_text).alias("have"))
    enough = F.size(F.array_intersect("need", "have")) >= F.lit(share) * F.size("need")
    carries = enough & F.forall("numbers", lambda n: F.contains(F.col("_e"), n))
    judged = s.join(e, key, "left").groupBy(key, "at", "sentence", "whole", F.size("need").alias("n")).agg(F.max(F.coalesce(carries, F.lit(False))).alias("carried"))
    return judged.select(key, "at", "sentence", (F.col("whole") & ((F.col("n") < short) | F.col("carried"))).alias("kept"))


def grounded_text(judged: DataFrame, key: str) -> DataFrame:
    """(key, text, kept, dropped): the kept sentences joined in order, and how many of each."""
    return judged.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("at", "sentence")))), lambda x: x["sentence"]), " ").alias("text"),
        F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"),
    )
