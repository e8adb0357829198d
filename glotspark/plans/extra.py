"""Registered queries of posts, repairs, templates and lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import repair as R
from ..operators import lexicon as L
from ..operators import posts as P
from ..operators import stats as S
from .registry import query, read

_BRAND = "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS slug, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS title, {_BRAND} AS brand, CASE WHEN p_size % 4 = 0 THEN 'own' WHEN p_size % 2 = 0 THEN ' ' ELSE 'see ![it](/i/' || p_partkey || '.png)' END AS content, '/i/' || p_partkey || '.png' AS thumbnail FROM part")
def localised_posts(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    raw = F.expr(f"concat('---\\ntitle: ', p_name, '\\nno field\\nbrand: ', {_BRAND}, '\\n---\\nsee ![it](/i/', p_partkey, '.png)')")
    own = F.expr("concat('---\\ntitle: ', p_type, '\\nbrand:  \\n---\\n', CASE WHEN p_size % 4 = 0 THEN 'own' ELSE ' ' END)")
    slug = F.col("p_partkey").cast("string")
    base = P.parsed(part.select(F.concat(slug, F.lit(".mdx")).alias("name"), raw.alias("raw")))
    out = P.localised(base, part.where("p_size % 2 = 0").select(slug.alias("slug"), own.alias("raw")))
    return out.select("slug", F.col("data")["title"].alias("title"), F.col("data")["brand"].alias("brand"), "content", "thumbnail")


@query("SELECT doc_id, 'latin-1>utf-8' AS pair, text FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]')")
def mojibake_repairs(spark, sf_dir):
    """Documents read with the wrong encoding, and the candidate of the pair that undoes it."""
    docs = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    found = docs.select("doc_id", F.explode(R.repairs(broken)).alias("r")).where("r.wrong = 'latin-1' AND r.true = 'utf-8'")
    return found.select("doc_id", F.concat_ws(">", "r.wrong", "r.true").alias("pair"), "r.text")


@query(
    "SELECT 'go' AS intent, 'en' AS lang, 'from ' || n_name || ' to ' || r_name || ', ' || n_name AS text, '5-' || (5 + length(n_name)) || ',' || (9 + length(n_name)) || '-' || (9 + length(n_name) + length(r_name)) || ',' || (11 + length(n_name) + length(r_name)) || '-' || (11 + 2 * length(n_name) + length(r_name)) AS spans FROM nation, region UNION ALL SELECT 'hi', 'en', 'hello', ''"
)
def template_examples(spark, sf_dir):
    templates = spark.sql("SELECT * FROM VALUES ('go', 'en', 'from {nation} to {region}, {nation}'), ('hi', 'en', 'hello'), ('go', 'ko', '{nation}') AS t(intent, lang, template)")
    values = read(spark, sf_dir, "nation").selectExpr("'nation' AS slot", "'en' AS lang", "n_name AS value").union(read(spark, sf_dir, "region").selectExpr("'region'", "'en'", "r_name"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return S.fill_templates(templates, values, 1_000_000).select("intent", "lang", "text", spans.alias("spans"))


_LEXICON = "SELECT CAST(p_partkey AS {text}) AS id, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey + 1 AS {text}) END AS broader, p_brand AS domain, CAST(NULL AS {text}) AS pos, p_name AS en, CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END AS ko, p_brand || '|' AS synonyms FROM part"


def _lexicon(spark, sf_dir):
    return spark.sql(_LEXICON.format(text="STRING").replace("FROM part", "FROM {part}"), part=read(spark, sf_dir, "part"))


@query(
    f"WITH c AS ({_LEXICON.format(text='VARCHAR')}) SELECT id AS s, 'rdf:type' AS p, 'skos:Concept' AS o FROM c UNION ALL SELECT id, 'skos:prefLabel', '\"' || en || '\"@en' FROM c UNION ALL SELECT id, 'skos:prefLabel', '\"' || ko || '\"@ko' FROM c WHERE ko <> ' ' UNION ALL SELECT id, 'dct:subject', '\"' || domain || '\"' FROM c UNION ALL SELECT id, 'skos:broader', broader FROM c WHERE broader IS NOT NULL UNION ALL SELECT id, 'skos:altLabel', '\"' || replace(synonyms, '|', '') || '\"' FROM c"
)
def lexicon_triples(spark, sf_dir):
    return L.triples(_lexicon(spark, sf_dir), ["en", "ko"])


@query(f"WITH c AS ({_LEXICON.format(text='VARCHAR')}) SELECT id, broader FROM c WHERE broader IS NOT NULL AND broader NOT IN (SELECT id FROM c)")
def lexicon_unresolved(spark, sf_dir):
    return L.warnings(_lexicon(spark, sf_dir))
