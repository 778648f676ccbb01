"""A bounded sample of labelled texts for the driver to fit a small model on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import fold, hashed_sample, text_or_empty


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text", most_chars: int = 60_000_000) -> tuple[list[str], list[int], float]:
    """Whole texts and 0/1 labels of at most ``most`` documents outside the held-out fold, and the share of label 1 there.

    Half of the documents are of each class, if there are as many.  In the order of hashed ids, texts are taken while they hold
    ``most_chars`` code points together at most, so that what the driver gets is bounded in size, too.

    The ids are drawn by hash from all labelled ids (the larger label, if an id has several), so the draw is
    the same on every run; only their texts are read to the driver.  Rows without id or label are left out.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.where("_id is not null and _label in (0, 1)").where(fold("_id") != 0).groupBy("_id").agg(F.max("_label").alias("_label"))
    share = known.agg(F.avg("_label")).first()[0]
    drawn = None
    for one in (0, 1):
        part = hashed_sample(known.where(F.col("_label") == one), "_id", most // 2)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text"))
    # At most ``most`` rows: of rows that share a drawn id, the text of least hash stands for the id.
    chosen = F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")
    rows = texts.join(F.broadcast(drawn), "_id").groupBy("_id", "_label").agg(chosen)
    so_far = F.sum(F.length("_text")).over(Window.orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id"))
    rows = rows.withColumn("_so_far", so_far).where(F.col("_so_far") <= most_chars).collect()
    rows.sort(key=lambda r: (r._id, r._text))
    return [r._text for r in rows], [r._label for r in rows], 0.5 if share is None else float(share)
