"""Entities and relations read out of sentences: measures, references, subject-verb-object templates, typed pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Verbs between two terms, and the relation each stands for.
VERBS = {
    "适用于": "applies_to", "要求": "requires", "评价": "evaluates", "支持": "supports", "参考": "references", "包括": "includes", "属于": "belongs_to",
    "用于": "used_for", "通过": "via", "进行": "conducts", "采用": "adopts", "依据": "based_on", "结合": "combines_with", "涉及": "involves",
}
#: Units of doses and of durations, letters of guideline series.
DOSE_UNITS = ("mg/kg", "g/kg", "μg/kg", "ml/kg", "L/kg", "mg/m²", "mL/kg")
DURATION_UNITS = ("天", "周", "月", "小时", "分钟", "秒", "日")
SERIES = ("S", "M", "E", "Q")
#: Regulatory concepts, and the studies that each bears on.
REGULATED = {
    "GLP": ("长期毒性试验", "急性毒性试验", "生殖毒性试验", "遗传毒性试验"),
    "NOAEL": ("长期毒性试验", "重复给药毒性研究"),
    "给药方式": ("长期毒性试验", "重复给药毒性研究"),
    "剂量设计": ("致癌试验", "长期毒性试验"),
    "QT间期延长": ("安全药理学试验",),
    "hERG通道": ("安全药理学试验",),
    "光安全性评价": ("光安全性评价",),
    "免疫毒性": ("免疫毒性研究", "免疫毒性试验"),
}
DOSE_RE = rf"(\d+(?:\.\d+)?)\s*(?:{'|'.join(DOSE_UNITS)})"
DURATION_RE = rf"(\d+\s*(?:{'|'.join(DURATION_UNITS)}))"
ICH_RE = rf"(ICH\s*[{''.join(SERIES)}]\d+(?:\([R\w]\))?)"
YEAR_RE = r"((?:19|20)\d{2})\s*年"


def measures(text: Column) -> Column:
    """Sorted, distinct doses, durations, guideline references and years of a text, each with its kind before it."""
    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(f"{kind}:"), F.regexp_replace(x, r"\s+", "")))

    return F.array_sort(F.array_distinct(F.concat(found("dose", DOSE_RE), found("duration", DURATION_RE), found("ich", ICH_RE), found("year", YEAR_RE))))


def triples(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) -> doc_id, source, relation, target, in a fixed order of verbs; terms of two characters or more."""
    def of(verb: str, name: str) -> Column:
        form = rf"([^\s,，、]+){verb}([^\s,，、]+)"
        both = F.arrays_zip(F.regexp_extract_all("text", F.lit(form), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(form), F.lit(2)).alias("b"))
        return F.transform(both, lambda p: F.struct(T.clean_entity(p["a"]).alias("source"), F.lit(name).alias("relation"), T.clean_entity(p["b"]).alias("target")))

    every = F.concat(*(of(v, n) for v, n in VERBS.items()))
    out = rows.select("doc_id", F.explode(every).alias("t")).select("doc_id", "t.*")
    return out.where((F.char_length("source") >= 2) & (F.char_length("target") >= 2) & (F.col("source") != F.col("target")))


def typed_pairs(found: DataFrame, first: str, second: str, relation: str) -> DataFrame:
    """found (doc_id, type, label): edges from every label of the first type to every one of the second in a document.

    The labels of a document are sets bounded by the vocabulary; they are paired where they are gathered.
    """
    sets = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("type") == first, F.col("label")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("type") == second, F.col("label")))).alias("b"))
    pairs = F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return sets.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.source", "p.target", F.lit(relation).alias("relation"))


def regulations(rows: DataFrame, pairs: dict[str, tuple[str, ...]] = REGULATED) -> DataFrame:
    """rows (doc_id, content) -> doc_id, source, relation, target: each concept of pairs with its studies, where a text holds both.

    The pairs are a short literal: one pass, no join; a null text holds nothing.
    """
    listed = F.array(*(F.struct(F.lit(c).alias("source"), F.lit("regulates").alias("relation"), F.lit(s).alias("target")) for c, of in pairs.items() for s in of))
    held = F.filter(listed, lambda p: F.contains("content", p["source"]) & F.contains("content", p["target"]))
    return rows.select("doc_id", F.explode(held).alias("p")).select("doc_id", "p.*")


def confidence_report(edges: DataFrame) -> DataFrame:
    """edges (confidence, confidence_score): shares of extracted, inferred and ambiguous edges, mean score of the inferred."""
    c = F.col("confidence")
    n = F.count("*")
    return edges.agg(
        n.alias("edges"), *(F.round(F.count_if(c == k.upper()) / n, 4).alias(k) for k in ("extracted", "inferred", "ambiguous")),
        F.round(F.avg(F.when(c == "INFERRED", F.col("confidence_score"))), 4).alias("inferred_score"))


def weak_nodes(edges: DataFrame) -> DataFrame:
    """node, inferred: how many inferred edges meet at each node."""
    rows = edges.where("confidence = 'INFERRED'").select(F.explode(F.array("source", "target")).alias("node"))
    return rows.groupBy("node").agg(F.count("*").alias("inferred"))
