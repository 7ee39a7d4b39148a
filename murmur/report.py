"""One call for the whole report over a folder of tables: every section a lazy frame, and the document as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections of the report and the queries that give them; all but the discussions are small, by a top-k or by their nature.
SECTIONS = {
    "metrics": "headline_metrics", "sentiment": "sentiment_mix", "keywords": "tfidf_keywords", "topics": "block_topics", "summary": "summary", "feed": "comment_feed", "trend": "trend_chart",
    "morphology": "morph_summary", "forms": "top_forms", "roots": "top_roots", "affixes": "affix_breakdown", "word_classes": "pos_breakdown",
    "unigrams": "top_unigrams", "bigrams": "top_bigrams", "trigrams": "top_trigrams", "ngrams": "ngram_summary", "phrase_trends": "phrase_trends", "tags": "pos_distribution", "taggers": "tagger_agreement", "confusion": "tagger_confusion", "key_words": "pos_key_words",
    "chunks": "chunk_types", "key_phrases": "key_phrases", "entity_types": "entity_types", "entities": "top_entities", "discussions": "discussion_sentiment", "redundancy": "redundancy", "senses": "wsd_report", "sense_breakdown": "wsd_breakdown", "entity_examples": "entity_examples", "tagger_examples": "tagger_examples", "chunk_example": "chunk_example",
}


def analyze_comments(spark: SparkSession, folder: str, sections: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The report's sections as frames. Unlike a dashboard it never falls back to invented data: a failing section fails."""
    from murmur.plans.registry import queries

    known = queries()
    return {name: known[SECTIONS[name]](spark, folder) for name in sections or tuple(SECTIONS)}


def document(sections: dict[str, DataFrame]) -> str:
    """The report as one JSON document."""
    return json.dumps({name: [json.loads(r) for r in frame.toJSON().collect()] for name, frame in sections.items()}, ensure_ascii=False)


def export(sections: dict[str, DataFrame], path: str) -> None:
    """Writes each section as one JSON file below the path, replacing an earlier snapshot; the sections are small reports."""
    for name, frame in sections.items():
        frame.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def union(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, row): the rows of all sections as JSON, in one frame that stays distributed."""
    out = None
    for name, frame in sections.items():
        rows = frame.select(F.lit(name).alias("section"), F.to_json(F.struct(*frame.columns)).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out
