"""Short readings of titles, keys and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import parse
from tessera.plans.catalog import query

#: People with their ids, and labels of stages. Parameters.
PEOPLE = {"ECONOMY": "eco", "STANDARD": "std", "PROMO": "promo"}
LABELS = {"base": "plain", "upgraded_2": "second"}


@query("""WITH t AS (SELECT p_partkey AS k, p_type, p_name, p_size, CASE p_partkey % 5 WHEN 0 THEN p_type || ' story' WHEN 1 THEN 'a-b-' || p_type WHEN 2 THEN 'x-' || p_type || 's' WHEN 3 THEN p_type || '-x' ELSE 'none' END AS title FROM part),
 n AS (SELECT *, CASE WHEN k % 5 IN (0, 1, 3) AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN p_type ELSE '' END AS name FROM t)
SELECT k AS p_partkey, name, CASE name WHEN 'ECONOMY' THEN 'eco' WHEN 'STANDARD' THEN 'std' WHEN 'PROMO' THEN 'promo' ELSE '' END AS id, CASE k % 5 WHEN 0 THEN CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN p_type ELSE title END WHEN 1 THEN 'a' WHEN 2 THEN 'x' WHEN 3 THEN p_type ELSE 'none' END AS person,
 CASE k % 6 WHEN 0 THEN 'II' WHEN 1 THEN 'I' WHEN 2 THEN 'III' WHEN 3 THEN 'none' WHEN 4 THEN 'I' ELSE '' END AS stage, CASE WHEN k % 3 = 0 THEN 'own' WHEN k % 3 = 1 THEN '守备技能' || (p_size + 1) ELSE (p_size + 1) || '技能' END AS key, k % 3 = 1 OR k % 4 = 0 AS guards, replace(replace(p_name, 'e', 'a'), 'o', 'u') AS letters, CASE WHEN k % 2 = 0 THEN p_name ELSE 'voice' END AS voice,
 CASE k % 5 WHEN 0 THEN 'gift' WHEN 1 THEN 'enemy' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE NULL END AS asked, p_name || '::' || left(repeat(p_name, 10), 80) AS document, CASE k % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'second' WHEN 2 THEN 'other' ELSE 'none' END AS label FROM n""")
def titles_read(read):
    """Whom a title names and by which id, stages, keys of skills, guards, letters made one, and the type that a filter asks for."""
    k, kind = F.col("p_partkey"), F.col("p_type")
    title = F.when(k % 5 == 0, F.concat(kind, F.lit(" story"))).when(k % 5 == 1, F.concat(F.lit("a-b-"), kind)).when(k % 5 == 2, F.concat(F.lit("x-"), kind, F.lit("s"))).when(k % 5 == 3, F.concat(kind, F.lit("-x"))).otherwise("none")
    stage = F.when(k % 6 == 0, "phase Ⅱ").when(k % 6 == 1, "II").when(k % 6 == 2, "no 3").when(k % 6 == 3, " none ").when(k % 6 == 4, "IV").otherwise("")
    filters = F.when(k % 5 == 0, '{"page_type": "gift"}').when(k % 5 == 1, '{"$and": [{"effect": "x"}, {"page_type": "enemy"}, {"page_type": "late"}]}').when(k % 5 == 2, '{"$and": "no list"}').when(k % 5 == 3, "not json")
    guard = F.when(k % 3 == 1, "evade").when(k % 3 == 2, "")
    said = F.when(k % 4 == 0, F.array(F.lit("x"), F.lit(" 守备技能 "))).when(k % 4 == 1, F.array(F.lit("守备技能 2")))
    who = parse.of_title(title, PEOPLE)
    voice = F.when(k % 2 == 0, F.concat(F.lit("  say: "), "p_name")).otherwise("voice ")
    named = F.when(k % 4 == 0, "base").when(k % 4 == 1, "upgraded_2").when(k % 4 == 2, "other").otherwise("")
    return read("part").select(
        "p_partkey", who["name"].alias("name"), who["id"].alias("id"), parse.person_of(title, PEOPLE).alias("person"), parse.stage_number(stage).alias("stage"), parse.skill_key(F.when(k % 3 == 0, "own"), guard, F.col("p_size")).alias("key"), parse.guards(guard, said).alias("guards"),
        parse.same_letters(F.col("p_name"), {"e": "a", "o": "u"}).alias("letters"), parse.without_prefix(voice, "say:").alias("voice"), parse.filtered_type(filters).alias("asked"), parse.document_key(F.col("p_name"), F.repeat("p_name", 10)).alias("document"), parse.named_stage(named, LABELS, "none").alias("label"),
    )
