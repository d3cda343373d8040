"""A survey view over the star-schema tables: responses, cells, predictions, completions.

No survey files ship with the tables, so answers are read from columns with few values:
order status and priority, return flags (overall and per supplier), event types, document
quality and language, and conversation roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurality.functions import dist, keys
from plurality.functions.rounding import r6
from plurality.operators.cells import QUESTION, cells_from_counts, count_answers
from plurality.plans.lineage import stored

SYSTEMS = ("uniform", "marginal", "half", "blend", "peaked")
DIMS = ("g1", "g2")
SUBSETS = ("half",)
_CELLS: dict[tuple[str, str], DataFrame] = {}


# Column types of the source tables; stating them saves a pass over the file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _answer(dataset, question, option, g1, g2, asked: Column | None = None) -> Column:
    """One answer of a source row; NULL where the row was not asked this question."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    fields = {"dataset": dataset, "question": question, "option": option, "g1": g1, "g2": g2}
    answer = F.struct(*[col(v).cast("string").alias(n) for n, v in fields.items()])
    return answer if asked is None else F.when(asked, answer)


def _answers(rows: DataFrame, half: Column, *answers: Column, n: Column | None = None) -> DataFrame:
    """All answers of a source in one pass over it; ``n`` says how many equal ones a row stands for."""
    more = [(half == 0).alias("half"), *([] if n is None else [n.alias("n")])]
    names = ["half", "n"][: len(more)]
    if len(answers) == 1:
        return rows.select(answers[0].alias("a"), *more).select("a.*", *names)
    out = rows.select(F.explode(F.array(*answers)).alias("a"), *more)
    return out.filter(F.col("a").isNotNull()).select("a.*", *names)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' demographics.  Customers grow with the orders, so they are merged and never sent to the driver."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    people = (
        t("customer")
        .join(t("nation"), c("c_nationkey") == c("n_nationkey"))
        .join(t("region"), c("n_regionkey") == c("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "n_name", "r_name")
    )
    return t("orders").join(people.hint("merge"), c("o_custkey") == c("c_custkey"))


def _order_answers() -> list[Column]:
    c = F.col
    person = (c("n_name"), c("c_mktsegment"))
    return [
        _answer(c("r_name"), "status", c("o_orderstatus"), *person),
        _answer(c("r_name"), "priority", c("o_orderpriority"), *person),
    ]


def _flag_answer() -> Column:
    c = F.col
    return _answer(c("r_name"), "returnflag", c("l_returnflag"), c("n_name"), c("c_mktsegment"), asked=c("o_orderkey").isNotNull())


def _supplier_answer() -> Column:
    c = F.col
    question = F.concat(F.lit("returned to supplier "), c("l_suppkey"))
    return _answer("suppliers", question, c("l_returnflag"), c("l_linestatus"), c("l_linenumber") % 2)


def _other_answers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Answers of the sources without orders."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    docs = t("documents").join(t("labels"), "doc_id", "left")
    size = F.when(c("n_chars") < 500, "short").when(c("n_chars") < 3000, "medium").otherwise("long")
    return [
        _answers(
            docs,
            c("doc_id") % 2,
            _answer(c("lang"), "quality", c("quality"), c("source"), c("toxic"), asked=c("quality").isNotNull()),
            _answer("documents", "lang", c("lang"), size, c("doc_id") % 4),
        ),
        _answers(
            t("events"),
            c("event_id") % 2,
            _answer("events", "event_type", c("event_type"), c("user_id") % 5, F.floor(F.hour("ts") / 6)),
        ),
        _answers(
            t("conversations"),
            c("conv_id") % 2,
            _answer("conversations", "role", c("role"), F.least(c("turn"), F.lit(4)), c("conv_id") % 5),
        ),
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per answer: dataset, question, option, two demographic variables, first-half flag."""
    c = F.col
    orders = _orders(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(
        orders.select("o_orderkey", "n_name", "r_name", "c_mktsegment"), c("l_orderkey") == c("o_orderkey"), "left"
    )
    return _union(
        [
            _answers(orders, c("o_orderkey") % 2, *_order_answers()),
            _answers(lines, c("l_orderkey") % 2, _flag_answer(), _supplier_answer()),
            *_other_answers(spark, sf_dir),
        ]
    )


def response_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of ``responses`` with a number ``n`` of equal ones.

    Order lines, the most rows by far, carry two columns into their join, and their answers are counted before they are spelled out.
    """
    c, count = F.col, F.count(F.lit(1)).alias("n")
    lines, orders = table(spark, sf_dir, "lineitem"), _orders(spark, sf_dir)
    orders = stored(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "n_name", "r_name", "c_mktsegment"), "orders")
    person = orders.select("o_orderkey", "n_name", "r_name", "c_mktsegment").hint("merge")
    flags = lines.select("l_orderkey", "l_returnflag").join(person, c("l_orderkey") == c("o_orderkey"))
    flags = flags.groupBy("r_name", "n_name", "c_mktsegment", "l_returnflag", (c("l_orderkey") % 2).alias("o_orderkey")).agg(count)
    given = ["l_suppkey", "l_returnflag", "l_linestatus", *[(c(k) % 2).alias(k) for k in ("l_linenumber", "l_orderkey")]]
    supplied = [lines.groupBy(*given).agg(count)]
    # a line answers once for each row of its order, so lines of repeated orders count more
    repeated = orders.groupBy("o_orderkey").agg((F.count(F.lit(1)) - 1).alias("more")).filter("more > 0")
    if not repeated.isEmpty():
        supplied.append(lines.join(repeated, c("l_orderkey") == c("o_orderkey")).groupBy(*given).agg(F.sum("more").alias("n")))
    stated = orders.groupBy("r_name", "n_name", "c_mktsegment", "o_orderstatus", "o_orderpriority", (c("o_orderkey") % 2).alias("o_orderkey")).agg(count)
    return _union(
        [
            _answers(stated, c("o_orderkey"), *_order_answers(), n=c("n")),
            *[part.withColumn("n", F.lit(1).cast("bigint")) for part in _other_answers(spark, sf_dir)],
            _answers(flags, c("o_orderkey"), _flag_answer(), n=c("n")),
            *[_answers(part, c("l_orderkey"), _supplier_answer(), n=c("n")) for part in supplied],
        ]
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the survey view, written once per session and source folder.

    Every operator reads cells several times; as a table they are computed once and scans
    of them prune columns and push filters down.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _CELLS:
        counts = stored(count_answers(response_counts(spark, sf_dir), DIMS, SUBSETS, "n"), "counts")
        rows = counts.count() * 2 ** len(DIMS)  # upper bound on cells, from the file footers
        _CELLS[key] = stored(cells_from_counts(counts, DIMS, SUBSETS), "cells", "record_id", rows)
    return _CELLS[key]


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Time and size of the source tables: changed tables give new cells."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for name in ("orders", "customer", "nation", "region", "lineitem", "documents", "labels", "events", "conversations"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append((status.getModificationTime(), status.getLen()))
    return tuple(found)


def forget() -> None:
    """Forget the written cells, so that the next query starts from the source tables again."""
    _CELLS.clear()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five systems per cell: uniform, the question's marginal, the first half, their blend, a sharpened marginal."""
    base = cells(spark, sf_dir)
    pop = base.filter(F.col("split") == "pop").select(*QUESTION, F.col("truth").alias("pop_truth"))
    rows = base.join(pop.hint("merge"), QUESTION, "left").select(  # questions grow with the input: no broadcast
        "record_id",
        "options",
        dist.uniform(F.col("options")).alias("uniform"),
        dist.align(F.col("pop_truth"), F.col("options")).alias("marginal"),
        dist.renorm(dist.align(F.col("half"), F.col("options"))).alias("half"),
    )
    mixed = F.zip_with("marginal", "half", lambda a, b: 0.5 * a + 0.5 * b)
    rows = rows.withColumns(
        {"blend": dist.renorm(mixed), "peaked": dist.temper(F.col("marginal"), F.lit(0.5))}
    )
    long = rows.select(
        "record_id",
        "options",
        F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("v")) for s in SYSTEMS])).alias("s"),
    )
    return long.select("record_id", "s.system", dist.as_map(F.col("options"), F.col("s.v")).alias("pred"))


# -- responses of the systems as text ----------------------------------------------


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response text per record and system; every seventh (by hash) is unreadable."""
    preds = predictions(spark, sf_dir)
    broken = keys.hash32(F.col("record_id"), F.col("system")) % 7 == 0
    fenced = F.concat(F.lit("Estimate: ```json "), F.to_json("pred"), F.lit(" ```"))
    return preds.select(
        "record_id", "system", F.when(broken, F.lit("I would rather not say.")).otherwise(fenced).alias("text")
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five draws per record, numbered in system order, stated with twice their mass; some unreadable."""
    preds = predictions(spark, sf_dir)
    draw = F.array_position(F.array(*[F.lit(s) for s in SYSTEMS]), F.col("system")).cast("int") - 1
    rows = preds.select("record_id", draw.alias("draw"), F.transform_values("pred", lambda _, v: v * 2).alias("m"))
    broken = keys.hash32(F.col("record_id"), F.col("draw").cast("string")) % 7 == 0
    stated = F.concat(F.lit("My view: "), F.to_json("m"), F.lit(" as asked."))
    return rows.select("record_id", "draw", F.when(broken, F.lit("{no idea}")).otherwise(stated).alias("text"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer as one vote text of its finest cell: JSON, a sentence, or an unknown label."""
    rows = responses(spark, sf_dir)
    record = F.concat(
        "dataset", F.lit("|"), "question", F.lit("|g1="), F.coalesce("g1", F.lit("NA")), F.lit("|g2="), F.coalesce("g2", F.lit("NA"))
    )
    odd = keys.hash32(record, F.col("option")) % 5 == 0
    as_json = F.concat(F.lit('{"choice": "'), "option", F.lit('"}'))
    unknown = F.concat(F.lit('{"choice": "'), "option", F.lit('?"}'))
    sentence = F.concat(F.lit("I would pick "), "option", F.lit("."))
    return rows.select(
        record.alias("record_id"), F.when(F.col("half"), as_json).when(odd, unknown).otherwise(sentence).alias("text")
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage row per event: model, token counts, native cost for some, cached flag."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), e).alias("key"),
        F.concat(F.lit("model_"), F.col("event_type")).alias("model"),
        (100 + F.col("user_id") * 3).alias("prompt_tokens"),
        (20 + e % 50).alias("completion_tokens"),
        F.when(e % 3 == 0, F.col("value") / 1000).alias("cost"),
        (e % 4 == 0).alias("cached"),
    )


# -- personas ----------------------------------------------------------------------

STATES = (
    "AK AL AR AZ CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR RI "
    "SC SD TN TX UT VA VT WA WI WV WY"
).split()
MARITAL = ("married_present", "never_married", "divorced", "widowed", "separated")
EDUCATION = (
    "less_than_9th",
    "9th_12th_no_diploma",
    "high_school",
    "some_college",
    "associates",
    "bachelors",
    "graduate",
)
OCCUPATIONS = ("not_in_workforce", "school_teacher", "retired", "sales_manager")


def _cycle(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic person per customer; attributes follow from the customer key."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), k).alias("uuid"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("sex"),
        (15 + (k * 7) % 70).cast("int").alias("age"),
        _cycle(MARITAL, k).alias("marital_status"),
        _cycle(EDUCATION, k).alias("education_level"),
        _cycle(STATES, k).alias("state"),
        F.initcap(F.lower("c_mktsegment")).alias("city"),
        _cycle(OCCUPATIONS, k).alias("occupation"),
        F.concat(F.col("c_name"), F.lit(" keeps a balance of "), F.floor("c_acctbal"), F.lit(".")).alias("persona"),
        F.when(k % 3 == 0, F.concat(F.lit("Works with nation "), F.col("c_nationkey"))).alias("professional_persona"),
        F.lit(None).cast("string").alias("cultural_background"),
        F.when(k % 5 == 0, F.lit("Collects stamps")).alias("hobbies_and_interests"),
    )


AGES = ("18-29", "30-49", "50-64", "65+", "17-")
SEXES = ("female", "male", "other")
REGIONS = ("Northeast", "Midwest", "South", "West")
MARITAL_ANSWERS = ("married", "never been married", "divorced", "widowed", "living with a partner")


def persona_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct demographic segments named by the orders, some of which no persona can be matched to."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    axes = {
        "AGE": F.when(o % 2 == 0, _cycle(AGES, c)),
        "SEX": F.when(o % 3 == 0, _cycle(SEXES, c)),
        "CREGION": F.when(o % 5 == 0, _cycle(REGIONS, c)),
        "MARITAL": F.when(o % 7 == 0, _cycle(MARITAL_ANSWERS, c)),
        "RACE": F.when(o % 11 == 0, F.lit("any")),
    }
    segment = F.map_filter(F.create_map(*[x for n, v in axes.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    rows = table(spark, sf_dir, "orders").select(segment.alias("segment"))
    return rows.withColumn("segment_key", keys.segment_key(F.col("segment"))).dropDuplicates(["segment_key"])


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order priority and one node per month with orders; parents by halving the position."""
    months = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("run_id"), F.trunc("o_orderdate", "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 1000).alias("price"))
    )
    # a run has one row per calendar month, so this window is small
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("month")) - 1
    rows = months.withColumn("seq", seq.cast("bigint"))
    s = F.col("seq")
    node = lambda i: F.concat(F.lit("n"), F.lpad(i.cast("string"), 4, "0"))
    return rows.select(
        "run_id",
        "seq",
        node(s).alias("node_id"),
        F.concat(F.lit("c"), s % 29).alias("config_hash"),
        F.when(s % 13 != 0, node(F.floor((s - 1) / 2))).alias("parent_id"),
        F.concat(F.lit("lever_"), s % 4).alias("lever_id"),
        F.concat(F.lit("month "), F.col("month").cast("string")).alias("rationale"),
        r6("price").alias("dev_score"),
        F.when(s % 3 != 2, r6(F.col("price") + s / 2)).alias("val_score"),
        F.when(s % 5 == 0, F.lit(0.0)).otherwise(F.col("n") / 100).alias("cost_usd"),
        (s % 2 == 0).alias("accepted"),
        F.create_map(F.lit("n"), F.col("n").cast("string")).alias("params"),
    )


# -- documents as survey items ------------------------------------------------------

OPENINGS = (
    "",
    "In a lottery: ",
    "Win $5 at 20% odds: ",
    "A moral dilemma: ",
    "Indicate your level of agreement: ",
    "The number game: ",
    "  ",
    "\n",
    "Say: ",
)
PROMPTS = (
    "You answer a European Social Survey item. The year is 2012.",
    "You are from Kenya. the year is 1999.",
    "",
    "A wisdom of crowds item.",
    "openpsychometrics",
)


def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one survey item, whole text, with varied openings, prompts, options and segments."""
    d = F.col("doc_id")
    options = F.when(d % 4 == 0, F.array(F.lit("Agree"), F.lit("Disagree"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    pairs = {
        "cntry": F.when(d % 4 == 1, F.lit("Finland")),
        "age_group": F.when(d % 4 == 1, F.lit("30-49")),
        "rlgdgr": F.when(d % 4 == 2, F.lit("7.0")),
        "shoe_size": F.when(d % 4 == 2, F.lit("big")),
        "SEX": F.when(d % 4 == 3, F.lit("female")),
        "domicil": F.when(d % 4 == 3, F.col("lang")),
    }
    segment = F.map_filter(F.create_map(*[x for n, v in pairs.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), d).alias("record_id"),
        F.col("source").alias("dataset"),
        F.lit("grouped").alias("split"),
        F.concat(
            _cycle(OPENINGS, d), "text", F.when(d % 3 == 0, F.lit("\nOptions:\n(A): yes\n(B): no")).otherwise(F.lit(""))
        ).alias("question"),
        _cycle(PROMPTS, d).alias("group_prompt"),
        options.alias("options"),
        segment.alias("segment"),
    )
