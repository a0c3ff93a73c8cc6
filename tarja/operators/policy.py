"""What happens to a found span: keep, replace or mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .spans import chunks, cut, merge_across_space, resolve_array, resolve_conflicts, splice_array

SCHEMA = "entity string, op string, new_value string, masking_char string, chars_to_mask int, from_end boolean, class int"

# Entity, operator and its value.
KEPT = [
    "DEFAULT",
    "PERSON",
    "LOCATION",
    "DATE_TIME",
    "ESTADO_CIVIL",
    "ORGANIZACAO_CONHECIDA",
    "ID_DOCUMENTO",
    "LEGAL_TITLE",
    "LEGAL_OR_COMMON_TERM",
    "TERMO_COMUM",
]
REPLACED = {
    "ENDERECO_LOGRADOURO": "<ENDERECO>",
    "EMAIL_ADDRESS": "<EMAIL>",
    "CPF": "<CPF/CIN>",
    "OAB_NUMBER": "<OAB>",
    "CEP_NUMBER": "<CEP>",
    "CNH": "***********",
    "SIAPE": "***",
    "RG_NUMBER": "<NUMERO RG>",
    "MATRICULA_SIAPE": "***",
}
MASKED = ["PHONE_NUMBER", "PHONE_NUMBER_BR"]
MASK_CHAR, MASK_LAST = "*", 4
PROTECTED = ["SAFE_LOCATION", "LEGAL_HEADER", "ESTADO_CIVIL", "ORGANIZACAO_CONHECIDA", "ID_DOCUMENTO", "CNH", "SIAPE", "MATRICULA_SIAPE"]
# End of the fixed values.


def default_policy(spark: SparkSession) -> DataFrame:
    """One row for each entity. ``class`` is the rank of E10: protected, replaced, masked, kept."""
    rank = lambda e, other: 1 if e in PROTECTED and e not in REPLACED else other
    rows = [(e, "keep", None, None, None, None, rank(e, 4)) for e in KEPT]
    rows += [(e, "replace", v, None, None, None, 2) for e, v in REPLACED.items()]
    rows += [(e, "mask", None, MASK_CHAR, MASK_LAST, True, 3) for e in MASKED]
    rows += [(e, "keep", None, None, None, None, 1) for e in PROTECTED if e not in KEPT and e not in REPLACED]
    return spark.createDataFrame(rows, SCHEMA)


def analysed_entities(policy: DataFrame, protected: DataFrame) -> DataFrame:
    """The policy's entities and the protected ones, without DEFAULT and PERSON."""
    return policy.select("entity").union(protected.select("entity")).distinct().where(~F.col("entity").isin("DEFAULT", "PERSON"))


FIELDS = ["op", "new_value", "masking_char", "chars_to_mask", "from_end"]


def with_policy(spans: DataFrame, policy: DataFrame) -> DataFrame:
    """Each span with its entity's operator and values; without one, with DEFAULT's, else keep. ``policy`` has a row
    for each entity (of several the least counts); Spark's size check decides whether it is broadcast."""
    own = policy.groupBy("entity").agg(F.min(F.struct(*FIELDS)).alias("__own"))
    default = own.where(F.col("entity") == "DEFAULT").select(F.lit(True).alias("__any"), F.col("__own").alias("__default"))
    met = spans.join(own, "entity", "left").withColumn("__any", F.lit(True)).join(default, "__any", "left")
    # an operator comes with its own values, none of DEFAULT's
    met = met.withColumn("__op", F.coalesce("__own", "__default"))
    return met.select(*(F.col(c) for c in spans.columns if c not in FIELDS), F.coalesce("__op.op", F.lit("keep")).alias("op"), *(F.col(f"__op.{c}").alias(c) for c in FIELDS[1:]))


def masked(found: Column, char: Column, n: Column, from_end: Column) -> Column:
    """P4."""
    k = F.least(F.coalesce(n, F.lit(0)), F.length(found))
    rest = F.length(found) - k
    stars = F.repeat(F.coalesce(char, F.lit(MASK_CHAR)), k)
    return F.when(F.coalesce(from_end, F.lit(True)), F.concat(F.substring(found, F.lit(1), rest), stars)).otherwise(F.concat(stars, F.substring(found, k + 1, rest)))


def replacement(found: Column) -> Column:
    """What stands in the text afterwards."""
    return F.when(F.col("op") == "replace", F.col("new_value")).when(F.col("op") == "mask", masked(found, F.col("masking_char"), F.col("chars_to_mask"), F.col("from_end"))).otherwise(found)


def apply_spans(docs: DataFrame, spans: DataFrame, policy: DataFrame, text: str = "text", by: str = "doc_id") -> DataFrame:
    """``docs`` with the spans applied to the text. ``by`` tells rows apart.

    Conflicts are resolved on rows without texts; the spans meet their text once, as one sorted
    array for each document."""
    clear = with_policy(resolve_conflicts(spans.select(by, "entity", "start", "end", "score"), by), policy)
    item = F.struct("start", "end", "entity", "op", "new_value", "masking_char", "chars_to_mask", "from_end")
    own = clear.groupBy(F.col(by).alias("__by")).agg(F.array_sort(F.collect_list(item)).alias("__spans"))
    met = docs.join(own, F.col(by) == F.col("__by"), "left").withColumn("__parts", F.when(F.col("__spans").isNotNull(), chunks(F.col(text))))
    both = F.struct(F.col("__parts").alias("parts"), F.col("__spans").alias("spans"))
    met = met.withColumn("__spans", F.when(F.col("__spans").isNotNull(), tx.let(both, lambda o: merge_across_space(o["parts"], o["spans"]))))

    def put(parts: Column, s: Column) -> Column:
        found = cut(parts, s["start"], s["end"])
        value = F.when(s["op"] == "replace", F.coalesce(s["new_value"], F.lit(""))).otherwise(masked(found, s["masking_char"], s["chars_to_mask"], s["from_end"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), value.alias("put"))

    met = met.withColumn("__put", F.when(F.col("__spans").isNotNull(), tx.let(both, lambda o: F.transform(F.filter(o["spans"], lambda s: s["op"] != "keep"), lambda s: put(o["parts"], s)))))
    done = tx.let(F.struct(F.col(text).alias("text"), F.col("__put").alias("put")), lambda o: splice_array(o["text"], o["put"]))
    return met.withColumn(text, tx.public_placeholder(F.when(F.size("__put") > 0, done).otherwise(F.col(text)))).drop("__by", "__spans", "__parts", "__put")


#: Rows of a policy that go into the plan; a longer one is joined.
LISTED = 1_000


def small_policy(policy: DataFrame, most: int = LISTED) -> list | None:
    """The rows of a policy that is small enough for the plan. An entity that stands twice is an error."""
    rows = policy.select("entity", *FIELDS).limit(most + 1).collect()
    if len(rows) > most:
        return None
    twice = {r["entity"] for r in rows if sum(x["entity"] == r["entity"] for x in rows) > 1}
    if twice:
        raise ValueError(f"the policy has several rows for {', '.join(sorted(twice))}")
    return rows


OPERATOR = "struct<op:string,new_value:string,masking_char:string,chars_to_mask:int,from_end:boolean>"


def operator_of(entity: Column, policy: list) -> Column:
    """P1 inside a row: the entity's operator with its values; without one DEFAULT's, else keep."""
    values = {r["entity"]: F.struct(*(F.lit(r[f]).alias(f) for f in FIELDS)).cast(OPERATOR) for r in policy}
    default = values.get("DEFAULT", F.struct(F.lit("keep").alias("op"), *(F.lit(None).alias(f) for f in FIELDS[1:])).cast(OPERATOR))
    if not values:
        return default
    return F.coalesce(F.try_element_at(F.create_map(*(x for e, v in values.items() for x in (F.lit(e), v))), entity), default)


def applied(text: Column, spans: Column, policy: list) -> Column:
    """E7 and P1 to P4 inside a row: array<struct<start, end, put, entity>> of what is to be replaced in the text, a column of its own."""

    def of(parts: Column) -> Column:
        def put(s: Column) -> Column:
            def value(o: Column) -> Column:
                found = cut(parts, s["start"], s["end"])
                new = F.when(o["op"] == "replace", F.coalesce(o["new_value"], F.lit(""))).otherwise(masked(found, o["masking_char"], o["chars_to_mask"], o["from_end"]))
                return F.struct(s["start"].alias("start"), s["end"].alias("end"), new.alias("put"), s["entity"].alias("entity"), (o["op"] == "keep").alias("stays"))

            return tx.let(operator_of(s["entity"], policy), value)

        return F.filter(F.transform(merge_across_space(parts, resolve_array(spans)), put), lambda x: ~x["stays"])

    found = F.transform(tx.let(chunks(text), of), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["put"].alias("put"), x["entity"].alias("entity")))
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int,put:string,entity:string>>"))


def entity_table(spans: DataFrame, *keep: str) -> DataFrame:
    """Accepted spans, before conflicts are resolved, with the columns ``keep``. Offsets refer to the text after name masking."""
    return spans.select(
        *keep,
        "doc_id",
        F.col("entity").alias("entidade"),
        tx.public_placeholder(F.col("found")).alias("texto_detectado"),
        F.col("start").alias("inicio"),
        F.col("end").alias("fim"),
        tx.format_score(F.col("score")).alias("score"),
    )
