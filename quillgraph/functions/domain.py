"""The reading domain: type tree, relation types with weights and the triplets they allow, and noise names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The domain's entity types, as full dotted names.
ENTITY_TYPES = (
    "person", "person.ruler", "person.philosopher", "person.character", "person.author", "work", "work.classic", "work.commentary", "work.novel", "concept", "concept.school", "concept.doctrine", "concept.pattern", "concept.theory",
    "event", "event.battle", "event.era", "location", "stem_branch", "stem_branch.heavenly", "stem_branch.earthly", "element",
)
# Relation types, their weights, and the (subject, object) types they allow; none means any.
RELATIONS: dict[str, tuple[float, tuple[tuple[str, str], ...]]] = {
    "AUTHORED": (10.0, (("person", "work"),)),
    "INFLUENCED_BY": (5.0, (("person", "person"), ("work", "work"), ("concept", "concept"), ("person", "concept"), ("event", "event"), ("event", "person"))),
    "DERIVES_FROM": (5.0, (("concept", "concept"), ("work", "work"))),
    "CONTRADICTS": (5.0, (("concept", "concept"), ("person", "person"))),
    "PARTICIPATED_IN": (5.0, (("person", "event"),)),
    "LOCATED_IN": (3.0, (("person", "location"), ("event", "location"), ("work", "location"))),
    "KNOWS": (3.0, (("person", "person"),)),
    "BELONGS_TO": (3.0, (("concept", "concept.school"), ("person", "concept.school"), ("work", "concept.school"))),
    "PRECEDES": (2.0, (("event", "event"), ("person", "person"))),
    "MENTIONS": (1.0, ()),
    "RIVAL_OF": (5.0, (("person", "person"), ("concept", "concept"))),
    "ALLY_OF": (5.0, (("person", "person"),)),
    "HEAVENLY_COMBINES": (8.0, (("stem_branch.heavenly", "stem_branch.heavenly"),)),
    "EARTHLY_COMBINES": (8.0, (("stem_branch.earthly", "stem_branch.earthly"),)),
    "EARTHLY_CLASHES": (8.0, (("stem_branch.earthly", "stem_branch.earthly"),)),
}
# Patterns of names that carry no knowledge.
NOISE = (
    "(?:数据|信息|管理|处理|控制|操作|运行|维护|支持)(?:系统|平台|中心|方式|方法|流程|机制)",
    r"^[A-Z][a-z]+,\s*[A-Z][a-z]+$",
    "^(?:问题|方法|因素|条件|情况|手段|途径|方式|过程|步骤|阶段|环节|方面|内容|形式|状态|特征|特点|类型|种类|模式)$",
    "(?:部门|小组|团队|委员会|理事会|协会|组织)$",
)


def relation_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, w, not t) for k, (w, t) in RELATIONS.items()], "relation_type string, schema_weight double, any_pair boolean")


def allowed_triplets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, o) for k, (_, pairs) in RELATIONS.items() for s, o in pairs], "relation_type string, subject string, object string")


def root_of(kind: Column) -> Column:
    return F.split_part(kind, F.lit("."), F.lit(1))


def is_noise(name: Column) -> Column:
    """Null, empty and one-character names are noise as well."""
    hit = F.lit(False)
    for pattern in NOISE:
        hit = hit | name.rlike(pattern)
    return F.coalesce(hit | (F.length(name) <= 1), F.lit(True))


def valid_triplets(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Edges (relation_type, type_a, type_b) that the domain allows.

    By default types are compared by their roots, so triplets that name a subtype never match; strict compares full
    types as well. Unknown relation types are dropped. Both dimensions have a fixed number of rows (the domain's own),
    so they are broadcast.
    """
    spark = edges.sparkSession
    kinds = edges.join(F.broadcast(relation_weights(spark)), "relation_type")
    pairs = F.broadcast(allowed_triplets(spark))
    roots = [root_of(F.col("type_a")), root_of(F.col("type_b"))]
    match = (F.col("subject") == roots[0]) & (F.col("object") == roots[1])
    if strict:
        match = (F.col("subject").isin(roots[0]) | (F.col("subject") == F.col("type_a"))) & ((F.col("object") == roots[1]) | (F.col("object") == F.col("type_b")))
    checked = kinds.filter("NOT any_pair").join(pairs.withColumnRenamed("relation_type", "allowed_type"), (F.col("relation_type") == F.col("allowed_type")) & match, "left_semi")
    return kinds.filter("any_pair").unionByName(checked)
