"""Registered queries: operators applied to the star-schema and text tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from stallbook.functions import texts
from stallbook.functions.numeric import half_up
from stallbook.operators import (
    change_feed,
    changes,
    chunks,
    daily,
    forecast,
    intents,
    matching,
    pages,
    quality,
    recency,
    retrieval,
    summaries,
    treatments,
    vector_index,
    windows,
)
from stallbook.operators import vectors as vectors_op
from stallbook.operators.keys import pack_ids, unpack_ids
from stallbook.operators.text_vectors import fit_text_vectors, term_weights, with_text_vectors
from stallbook.plans import advice, model, report
from stallbook.plans import prices as price_plan
from stallbook.plans.observations import from_lines, price_observations, table, unit_prices
from stallbook.session import freed, scratch_path, settle
from stallbook.sinks import layout
from stallbook.sinks import tables as sinks
from stallbook.sources import files, rescue, tables
from stallbook.streaming import gold, gold_states, ingest, metrics
from stallbook.streaming.silver import dedupe_stream, drain_unique, silver_stream
from stallbook.streaming.survivors import drain_survivors, read_survivors

#: Rows of a table that are written to one file, where files are made to be read again.
FILE_ROWS = 1_000_000


def _packed(rows: DataFrame) -> DataFrameWriter:
    """Lines that repeat much are written packed, in few files for each task, since each is read by one."""
    return rows.write.option("compression", "lz4").option("maxRecordsPerFile", FILE_ROWS)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# ---- prices -----------------------------------------------------------------


@_query
def gold_price_analytics(spark, folder):
    return summaries.monthly_analytics(price_plan.silver(price_observations(spark, folder)))


@_query
def silver_prices(spark, folder):
    return price_plan.silver(price_observations(spark, folder), deduplicate=True)


@_query
def price_enriched(spark, folder):
    return price_plan.enriched(price_observations(spark, folder))


@_query
def commodity_summary(spark, folder):
    return summaries.commodity_summary(price_observations(spark, folder))


@_query
def commodity_analytics(spark, folder):
    return summaries.commodity_analytics(price_observations(spark, folder))


@_query
def top_commodities(spark, folder):
    return summaries.top_commodities(price_observations(spark, folder))


@_query
def commodity_counts(spark, folder):
    return summaries.commodity_counts(price_observations(spark, folder))


@_query
def daily_trend(spark, folder):
    return summaries.daily_trend(price_plan.enriched(price_observations(spark, folder)))


@_query
def trend_overview(spark, folder):
    trend = summaries.daily_trend(price_plan.enriched(price_observations(spark, folder)))
    return summaries.trend_overview(trend)


@_query
def trend_last_n_days(spark, folder):
    return daily.price_trend(price_observations(spark, folder), ("commodity", "state"), days=90)


@_query
def daily_prices(spark, folder):
    return daily.price_trend(price_observations(spark, folder), ("commodity",), days=None)


@_query
def best_markets(spark, folder):
    return recency.best_markets(price_observations(spark, folder))


@_query
def state_comparison(spark, folder):
    return recency.state_comparison(price_observations(spark, folder))


@_query
def latest_prices(spark, folder):
    return recency.latest_prices(price_observations(spark, folder))


@_query
def price_forecast(spark, folder):
    return forecast.price_forecast(price_observations(spark, folder), ("commodity", "state"))


@_query
def price_outlook(spark, folder):
    return forecast.price_outlook(price_observations(spark, folder))


@_query
def commodity_outlook(spark, folder):
    return forecast.price_outlook(price_observations(spark, folder), ("commodity",))


@_query
def dimension_lists(spark, folder):
    places = price_observations(spark, folder).select("commodity", "state", "market").distinct()
    places = settle(places, "places")
    return (
        summaries.value_lists(places, ["commodity"], "state")
        .join(summaries.value_lists(places, ["commodity"], "market"), "commodity")
    )


@_query
def dimension_pages(spark, folder):
    """Lists of markets per commodity, in pages of seven."""
    return pages.value_pages(price_observations(spark, folder), ["commodity"], "market", 7)


@_query
def market_choices(spark, folder):
    return summaries.distinct_values(price_observations(spark, folder), "commodity", "state", "market")


@_query
def first_commodities(spark, folder):
    return summaries.first_commodities(price_observations(spark, folder))


@_query
def rule_counts(spark, folder):
    return quality.rule_counts(price_observations(spark, folder), quality.price_rules())


# the same operators on prices with four decimals


@_query
def unit_price_analytics(spark, folder):
    return summaries.monthly_analytics(price_plan.silver(unit_prices(spark, folder)))


@_query
def unit_price_enriched(spark, folder):
    return price_plan.enriched(unit_prices(spark, folder))


@_query
def unit_price_summary(spark, folder):
    return summaries.commodity_analytics(unit_prices(spark, folder))


@_query
def unit_price_markets(spark, folder):
    return recency.best_markets(unit_prices(spark, folder))


@_query
def unit_price_trend(spark, folder):
    return daily.price_trend(unit_prices(spark, folder), ("commodity", "state"), days=90)


@_query
def unit_price_forecast(spark, folder):
    return forecast.price_forecast(unit_prices(spark, folder), ("commodity", "state"))


def _wide_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices beyond a million millions, and with nine decimals, among plain ones."""

    def price(column: str):
        value = F.col(column)
        units, hundredths = F.floor(value).cast("bigint"), F.floor(value * 100 + 0.5).cast("bigint")
        fine = (units % 1000 * 1_000_000_000 + hundredths % 997) / 1_000_000_000
        large = (units * 1_000_000_000_000).cast("double")
        return F.when(F.col("variety") == "R", large).when(F.col("variety") == "A", fine).otherwise(value)

    prices = {c: price(c) for c in ("min_price", "max_price", "modal_price")}
    return price_observations(spark, folder).withColumns(prices)


@_query
def wide_price_analytics(spark, folder):
    return summaries.monthly_analytics(price_plan.silver(_wide_prices(spark, folder))).drop("price_stddev")


@_query
def wide_price_enriched(spark, folder):
    enriched = price_plan.enriched(_wide_prices(spark, folder))
    return enriched.select("price_id", "modal_price", "moving_avg_7d", "moving_avg_30d")


# ---- price files --------------------------------------------------------------


def _raw_price_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Observations under the headers of raw price files."""
    return price_observations(spark, folder).select(
        F.col("state").alias("State"),
        F.col("district").alias("District Name"),
        F.col("market").alias("Market Name"),
        F.col("commodity").alias("Commodity"),
        F.col("variety").alias("Variety"),
        F.col("grade").alias("Grade"),
        F.date_format("arrival_date", "dd MMM yyyy").alias("Price Date"),
        F.col("min_price").alias("Min Price (Rs./Quintal)"),
        F.col("max_price").alias("Max Price (Rs./Quintal)"),
        # unusable texts, as they occur in such files
        F.when(F.col("grade") == "F", F.col("modal_price").cast("string"))
        .otherwise("NR")
        .alias("Modal Price (Rs./Quintal)"),
    )


FILE_COLUMNS = list(files.PRICE_HEADERS)


@_query
def price_files_json(spark, folder):
    path = scratch_path(spark, "json")
    _raw_price_rows(spark, folder).write.json(path)
    return files.load_prices(spark, path, multi_line=False).select(FILE_COLUMNS)


def _price_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Price rows as lines of JSON: a third cut off, some with a column nobody expects."""
    rows = _raw_price_rows(spark, folder)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    line = F.when(F.col("Variety") == "R", F.to_json(F.struct(*columns, F.lit("7 %").alias("Moisture")))).otherwise(F.to_json(F.struct(*columns)))
    cut = F.when(F.col("Variety") == "A", F.substring(line, 1, 60)).otherwise(line)
    return rows.select("Variety", cut.alias("value"))


@_query
def price_files_rescued(spark, folder):
    """Every line of a price file is either loaded or rescued."""
    path = scratch_path(spark, "lines")
    _packed(_price_lines(spark, folder).select("value")).text(path)
    # every line is parsed once, not by each of the counts below
    lines = settle(rescue.read_lines(spark, path, files.PRICE_FILE), "read_lines")
    # the lines that are loaded pass through the usual projection
    good = files.price_columns(rescue.loaded(lines)).groupBy("variety").agg(F.count("*").alias("rows"), F.count("modal_price").alias("prices"))
    good = good.select(F.lit("loaded").alias("rule"), "variety", "rows", "prices")
    bad = rescue.rescued(lines).groupBy("rule", "column").agg(F.count("*").alias("rows"))
    return good.union(bad.select("rule", "column", "rows", F.lit(0).cast("bigint")))


@_query
def rescued_lines(spark, folder):
    """The broken lines themselves, whole."""
    path = scratch_path(spark, "lines")
    _price_lines(spark, folder).select("value").write.text(path)
    lines = rescue.read_lines(spark, path, files.PRICE_FILE)
    return rescue.rescued(lines).filter(F.col("rule") == rescue.BROKEN).groupBy("content").agg(F.count("*").alias("rows"))


@_query
def price_files_lineage(spark, folder):
    """Rows by the folder that their file lies in."""
    path = scratch_path(spark, "json")
    rows = _raw_price_rows(spark, folder)
    for grade in ("F", "O"):
        rows.filter(F.col("Grade") == grade).write.json(f"{path}/grade_{grade}")
    raw = files.read_json(spark, f"{path}/*", files.FILE_SCHEMAS["prices"], multi_line=False)
    place = F.regexp_extract("source_file", "/(grade_.)/[^/]*$", 1).alias("place")
    return files.price_rows(raw).groupBy(place, "grade").agg(F.count("*").alias("rows"))


@_query
def price_files_remembered(spark, folder):
    """Files read with the schema that was inferred from earlier ones."""
    first, later, memory = (scratch_path(spark, x) for x in ("json", "json", "schema"))
    rows = _raw_price_rows(spark, folder)
    for some, path in ((rows.filter("Grade = 'F'").drop("Variety"), first), (rows, later)):
        _packed(some).json(path)
    files.remembered_schema(spark, first, memory, multi_line=False)
    schema = files.remembered_schema(spark, later, memory, multi_line=False)
    raw = files.read_json(spark, later, schema, multi_line=False)
    return files.price_rows(raw).select(FILE_COLUMNS)


def _named_files(spark: SparkSession, path: str, prefix: str) -> None:
    """Put a prefix before the names of the files of a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("part-"):
            system.rename(status.getPath(), hadoop.Path(root, prefix + name))


@_query
def stream_ingest_by_name(spark, folder):
    """Of a folder with files of two sources the price files are taken, by name."""
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "raw")
    _packed(_raw_price_rows(spark, folder)).json(inbox)
    _named_files(spark, inbox, "market_prices_")
    _documents_as_schemes(spark, folder).write.mode("append").json(inbox)
    _named_files(spark, inbox, "schemes_")
    rows = ingest.source_stream(spark, "prices", inbox, f"{files.FILE_PATTERNS['prices']}.lz4", multi_line=False)
    ingest.drain(rows, scratch_path(spark, "offsets"), path=out)
    return spark.read.schema(rows.schema).parquet(out).select(FILE_COLUMNS)


@_query
def scheme_files(spark, folder):
    path = scratch_path(spark, "schemes")
    _documents_as_schemes(spark, folder).write.json(path)
    raw = files.read_json(spark, path, files.FILE_SCHEMAS["schemes"], multi_line=False)
    return chunks.scheme_chunks(files.scheme_rows(raw))


@_query
def knowledge_files(spark, folder):
    path = scratch_path(spark, "knowledge")
    _awkward_labels(spark, folder).select(
        F.col("label").alias("disease_class"),
        F.col("doc_id").cast("string").alias("treatment"),
        F.lit("p").alias("prevention"),
        F.lit("o").alias("organic"),
    ).write.json(path)
    raw = files.read_json(spark, path, files.FILE_SCHEMAS["knowledge"], multi_line=False)
    return files.knowledge_rows(raw).drop("source_file")


@_query
def guide_files(spark, folder):
    path = scratch_path(spark, "guide")
    _parts_as_guide(spark, folder).write.json(path)
    raw = files.read_json(spark, path, files.FILE_SCHEMAS["guide"], multi_line=False)
    return chunks.guide_chunks(files.guide_rows(raw))


@_query
def price_files_csv(spark, folder):
    path = scratch_path(spark, "csv")
    _raw_price_rows(spark, folder).write.option("header", True).csv(path)
    return files.load_prices(spark, path, "csv").select(FILE_COLUMNS)


@_query
def stream_ingest(spark, folder):
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "raw")
    _raw_price_rows(spark, folder).write.json(inbox)
    rows = ingest.source_stream(spark, "prices", inbox, pattern="*.json", multi_line=False)
    ingest.drain(rows, scratch_path(spark, "offsets"), path=out)
    return spark.read.schema(rows.schema).parquet(out).select(FILE_COLUMNS)


# ---- log rows -------------------------------------------------------------------


@_query
def price_log(spark, folder):
    days = forecast.price_forecast(price_observations(spark, folder), ("commodity", "state"))
    return sinks.price_log_rows(days).drop("prediction_id", "timestamp")


@_query
def price_log_table(spark, folder):
    """The log tables are created empty and typed, then appended to."""
    path = scratch_path(spark, "logs")
    database = "logs_" + path[-12:]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    sinks.create_log_tables(spark, database)
    days = forecast.price_forecast(price_observations(spark, folder), ("commodity", "state"))
    sinks.append_log(sinks.price_log_rows(days), f"{database}.price_predictions_log")
    rows = settle(tables.read_table(spark, f"{database}.price_predictions_log"), "log")
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return rows.drop("prediction_id", "timestamp")


@_query
def chat_log(spark, folder):
    routed = intents.with_feature(intents.classify(_turns(spark, folder), lexicon=TONGUES))
    return sinks.chat_log_rows(routed, answer="text").drop("session_id", "timestamp")


@_query
def disease_log(spark, folder):
    treated = treatments.parse_labels(_document_labels(spark, folder))
    return sinks.disease_log_rows(treated).drop("prediction_id", "timestamp")


# ---- texts --------------------------------------------------------------------


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@_query
def keyword_topk(spark, folder):
    return matching.keyword_top_k(_questions(spark, folder), _texts(spark, folder), k=5)


@_query
def keyword_topk_whole_word(spark, folder):
    return matching.keyword_top_k(
        _questions(spark, folder), _texts(spark, folder), k=5, whole_word=True
    )


@_query
def context_assembly(spark, folder):
    return retrieval.answers(_questions(spark, folder), _texts(spark, folder), mode="keyword").select(
        "query_id", "answer"
    )


@_query
def search_auto(spark, folder):
    """Without vectors on both sides the search goes by words."""
    return retrieval.search(_questions(spark, folder), _texts(spark, folder), k=5)


@_query
def doc_detail(spark, folder):
    return chunks.scheme_detail(_documents_as_schemes(spark, folder), "7")


@_query
def vector_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    centres = vectors_op.centroids(vectors, "label")
    return vectors_op.cosine_top_k(centres, vectors, k=5, query_id="label", vector_id="vec_id")


@_query
def vector_neighbours(spark, folder):
    """Every stored vector as a query."""
    vectors = table(spark, folder, "embeddings")
    return vectors_op.cosine_top_k(vectors, vectors, k=5, query_id="vec_id", vector_id="vec_id")


def _vector_index(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "index")
    vector_index.build_index(table(spark, folder, "embeddings"), path, "vec_id")
    return path


@_query
def vector_index_topk(spark, folder):
    """The search of ``vector_topk`` through a stored index."""
    centres = vectors_op.centroids(table(spark, folder, "embeddings"), "label")
    return vector_index.search_index(spark, _vector_index(spark, folder), centres, 5, "label")[0]


@_query
def vector_index_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return vector_index.search_index(spark, _vector_index(spark, folder), vectors, 5, "vec_id")[0]


@_query
def vector_index_cells(spark, folder):
    """Every vector lies in one cell, within the cell's widest angle."""
    path = _vector_index(spark, folder)
    held = spark.read.parquet(f"{path}/vectors").join(spark.read.parquet(f"{path}/cells").withColumnRenamed("angle", "widest"), "cell")
    return held.select(F.col("vector_id").alias("vec_id"), (F.col("angle") <= F.col("widest")).alias("inside"))


@_query
def text_vectors(spark, folder):
    documents = _texts(spark, folder)
    return with_text_vectors(documents, fit_text_vectors(documents)).select("chunk_id", "embedding")


@_query
def text_vector_search(spark, folder):
    questions, documents = advice.with_vectors(_questions(spark, folder), _texts(spark, folder))
    return retrieval.search(questions, documents, k=5, mode="vector")


def _documents_as_schemes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("scheme_id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("name"),
        F.when(F.col("lang") != "fr", F.concat_ws(" ", "lang", F.lit("text"))).alias("name_en"),
        F.col("lang").alias("category"),
        F.col("text").alias("description"),
        F.array("lang", "source").alias("eligibility"),
        F.col("text").alias("benefits"),
        F.lit(None).cast("string").alias("how_to_apply"),
        F.array("source", F.col("n_chars").cast("string")).alias("documents_required"),
        F.concat(F.lit("https://example.com/"), "source").alias("official_url"),
        F.lit("none").alias("helpline"),
        F.col("source").alias("coverage"),
    )


@_query
def doc_chunks(spark, folder):
    return chunks.scheme_chunks(_documents_as_schemes(spark, folder))


@_query
def doc_chunks_bracketed(spark, folder):
    return chunks.scheme_chunks(_documents_as_schemes(spark, folder), list_style="bracketed")


@_query
def ask_schemes(spark, folder):
    """Questions answered from the two texts of every scheme."""
    answered = advice.ask_schemes(_questions(spark, folder), _documents_as_schemes(spark, folder))
    return answered.select("query_id", "answer")


@_query
def table_comments(spark, folder):
    """A stored table with comments, as the catalog tells them."""
    path = scratch_path(spark, "orders")
    name = "orders_" + path[-12:]
    orders = table(spark, folder, "orders")
    marked = orders.select(*[F.col(c).alias(c, metadata={"comment": f"{c} of an order, it's"}) for c in orders.columns])
    sinks.write_table(marked, name, location=path)
    sinks.comment_table(spark, name, "Orders: what's new")
    rows = [(c.name, c.description) for c in spark.catalog.listColumns(name)]
    about = spark.catalog.getTable(name).description
    counted = tables.read_table(spark, name).count()
    spark.sql(f"DROP TABLE {name}")
    columns = spark.createDataFrame([(n, d, about) for n, d in rows], "name string, comment string, about string")
    return columns.withColumn("rows", F.lit(counted).cast("bigint"))


@_query
def chunk_files(spark, folder):
    path = scratch_path(spark, "chunks")
    sinks.write_chunks(chunks.scheme_chunks(_documents_as_schemes(spark, folder)), path)
    return spark.read.schema("scheme_id string, name string, category string, chunk_type string, text string").json(path)


@_query
def doc_list(spark, folder):
    return chunks.scheme_list(_documents_as_schemes(spark, folder))


def _parts_as_guide(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("crop"),
        F.col("p_type").alias("growth_stage"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("category"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("problem"),
        F.col("p_name").alias("product_name"),
        F.col("p_size").cast("string").alias("dosage"),
        F.lit(None).cast("string").alias("application_method"),
        F.lit("any").alias("timing"),
        F.lit("₹").alias("precautions"),
        F.lit("").alias("organic_alternative"),
        F.col("p_partkey").cast("string").alias("cost_estimate"),
    )


@_query
def guide_chunks(spark, folder):
    return chunks.guide_chunks(_parts_as_guide(spark, folder))


@_query
def guide_lists(spark, folder):
    guide = _parts_as_guide(spark, folder)
    stages = summaries.value_lists(guide, ["crop"], "growth_stage")
    return stages.select("crop", F.array_join("growth_stage_list", ", ").alias("growth_stages"))


@_query
def guide_categories(spark, folder):
    return summaries.distinct_values(_parts_as_guide(spark, folder), "category")


@_query
def guide_recommendations(spark, folder):
    """A request per part kind, answered from the part texts."""
    requests = (
        _parts_as_guide(spark, folder)
        .groupBy("growth_stage", "category")
        .agg(F.max("crop").alias("crop"))
        .select(
            F.concat_ws("/", "growth_stage", "category").alias("query_id"),
            "crop",
            "growth_stage",
            F.col("category").alias("problem"),
            (F.col("category") == "ring").alias("prefer_organic"),
        )
    )
    return advice.recommend(requests, _parts_as_guide(spark, folder)).select("query_id", "text", "answer")


# words that occur in the conversations, by language
TONGUES = {
    "english": ("the", "tion", "and", "with"),
    "german": ("der", "ung", "und", "sch"),
    "french": ("eau", "que", "les", "des"),
    "spanish": ("los", "ción", "por", "una"),
}


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")


@_query
def intent_classify(spark, folder):
    return intents.classify(_turns(spark, folder), lexicon=TONGUES).drop("text")


@_query
def intent_classify_default(spark, folder):
    return intents.classify(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@_query
def intent_classify_whole_word(spark, folder):
    return intents.classify(_turns(spark, folder), lexicon=TONGUES, whole_word=True).drop("text")


@_query
def entity_extract(spark, folder):
    named = intents.extract_names(
        _turns(spark, folder), commodities=("thing", "heit", "eau", "ing"), crops=("ment", "sch", "ble")
    )
    return named.drop("text")


@_query
def entity_extract_default(spark, folder):
    return intents.extract_names(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@_query
def question_routes(spark, folder):
    routed = intents.with_feature(intents.classify(_turns(spark, folder)))
    return intents.with_preview(routed, "text").drop("text")


@_query
def routing_counts(spark, folder):
    routed = intents.with_feature(intents.classify(_turns(spark, folder), lexicon=TONGUES))
    return intents.routing_counts(routed)


# ---- labels, versions, keys -----------------------------------------------------


def _document_labels(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("source") == "src1", "healthy").otherwise("spots")
    number = F.col("doc_id").cast("string")
    label = F.concat(F.lit("Doc_"), "lang", F.lit("___"), state, F.lit("_"), number)
    return table(spark, folder, "documents").select("doc_id", label.alias("label"))


@_query
def label_lookup(spark, folder):
    knowledge = _document_labels(spark, folder).join(table(spark, folder, "labels"), "doc_id").select(
        F.col("label").alias("disease_class"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("treatment"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("prevention"),
        F.when(F.col("toxic") == 0, "none needed").alias("organic"),
        "doc_id",
    )
    return treatments.with_treatments(_document_labels(spark, folder), knowledge, position="doc_id")


# class labels with commas, brackets, blanks and underscores, and none at all
AWKWARD_LABELS = (
    "Pepper,_bell___Bacterial_spot",
    "Corn_(maize)___Common_rust_",
    "Corn_(maize)___Cercospora_leaf_spot Gray_leaf_spot",
    "Tomato___Spider_mites Two-spotted_spider_mite",
    "Grape___healthy",
    "no separator",
    "",
)


def _awkward_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with one of the labels, or null."""
    labels = F.array(*[F.lit(x) for x in AWKWARD_LABELS])
    place = (F.col("doc_id") % (len(AWKWARD_LABELS) + 1)).cast("int")
    return table(spark, folder, "documents").select("doc_id", F.get(labels, place).alias("label"))


@_query
def awkward_labels(spark, folder):
    return treatments.parse_labels(_awkward_labels(spark, folder))


@_query
def repeated_labels(spark, folder):
    """Every label has many entries; the last one counts."""
    known = _awkward_labels(spark, folder).select(
        F.col("label").alias("disease_class"),
        F.col("doc_id").cast("string").alias("treatment"),
        F.lit("p").alias("prevention"),
        F.lit(None).cast("string").alias("organic"),
        "doc_id",
    )
    return treatments.with_treatments(_awkward_labels(spark, folder), known, position="doc_id")


@_query
def ingest_labels(spark, folder):
    return _document_labels(spark, folder).select(
        "doc_id",
        texts.ingest_crop("label").alias("crop"),
        texts.ingest_disease("label").alias("disease_name"),
    )


@_query
def top_predictions(spark, folder):
    lines, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    scores = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("image_id"), F.col("p_brand").alias("label"))
        .agg((F.sum("l_quantity") / 8192).alias("score"))
    )
    return treatments.with_confidence(treatments.top_predictions(scores))


def _order_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders and a batch of changes: open orders closed, urgent ones copied."""
    old = table(spark, folder, "orders")
    closed = old.filter("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("F"))
    copies = old.filter("o_orderpriority = '1-URGENT'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return old, closed.unionByName(copies)


@_query
def upsert(spark, folder):
    old, new = _order_versions(spark, folder)
    return changes.upsert(old, new, ["o_orderkey"])


@_query
def upsert_repeated_keys(spark, folder):
    """A batch that has keys several times: the row of the latest status counts."""
    old, new = _order_versions(spark, folder)
    twice = new.unionByName(new.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("Z")))
    return changes.upsert(old, twice, ["o_orderkey"], order=["o_orderstatus"])


@_query
def apply_changes(spark, folder):
    """The differences of three versions, applied newest first: the last version comes out."""
    versions = _order_history(spark, folder)
    key = ["o_orderkey"]
    history = change_feed.new_history(versions[0], key, 0)
    for number in (3, 1, 2):
        history = settle(change_feed.apply_changes(history, _numbered_changes(versions, number), key, "sequence"), "history")
    return change_feed.version(history)


@_query
def change_intervals(spark, folder):
    """How long every state of an order was valid."""
    versions = _order_history(spark, folder)
    key = ["o_orderkey"]
    history = change_feed.new_history(versions[0], key, 0)
    steps = _numbered_changes(versions, 1).unionByName(_numbered_changes(versions, 2)).unionByName(_numbered_changes(versions, 3))
    history = change_feed.apply_changes(history, steps, key, "sequence")
    return history.select("o_orderkey", "o_orderstatus", "valid_from", "valid_to", "deleted")


def _order_history(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Four versions of orders: changed, thinned out, and partly back."""
    old, new = _order_versions(spark, folder)
    second = changes.replace_rows(old, new, ["o_orderkey"])
    third = second.filter("o_orderkey % 5 <> 0")
    back = old.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("B"))
    return [old, second, third, third.unionByName(back)]


def _numbered_changes(versions: list[DataFrame], number: int) -> DataFrame:
    found = changes.snapshot_diff(versions[number - 1], versions[number], ["o_orderkey"]).drop("copies")
    return found.withColumn("sequence", F.lit(number))


#: Bytes of a silver row as it is shuffled.
SILVER_BYTES = 128


@_query
def bucketed_enriched(spark, folder):
    """Indicators over a silver table in buckets of its series: no exchange below the windows."""
    path = scratch_path(spark, "silver")
    name = "silver_" + path[-12:]
    rows = price_plan.silver(price_observations(spark, folder))
    buckets = layout.buckets_for(table(spark, folder, "lineitem").count() * SILVER_BYTES, 8)
    layout.write_bucketed(rows, name, windows.SERIES, windows.ORDER, buckets, path)
    clean = quality.dedupe(spark.table(name), [*windows.SERIES, "arrival_date", "variety"])
    enriched = windows.with_indicators(clean)
    if layout.exchanges(enriched):
        raise RuntimeError("the stored layout is not used")
    kept = settle(enriched, "enriched")
    spark.sql(f"DROP TABLE {name}")
    return kept


@_query
def bucketed_merge(spark, folder):
    """Orders in buckets of their key; only the batch is shuffled when it is merged."""
    old, new = _order_versions(spark, folder)
    paths = [scratch_path(spark, "orders") for _ in range(2)]
    names = ["orders_" + p[-12:] for p in paths]
    layout.write_bucketed(old, names[0], ["o_orderkey"], (), 8, paths[0])
    layout.merge_bucketed(new, names[0], ["o_orderkey"], (), names[1], paths[1])
    spark.sql(f"DROP TABLE {names[0]}")
    return _read_and_forget(spark, names[1])


@_query
def table_inventory(spark, folder):
    """Tables of a database by name, with their sizes; one that is asked for is missing."""
    path = scratch_path(spark, "inventory")
    database = "inventory_" + path[-12:]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    for name in ("nation", "orders", "documents"):
        sinks.write_table(table(spark, folder, name), f"{database}.{name}")
    names = sorted(tables.list_tables(spark, database))
    found = settle(tables.table_stats(spark, [f"{database}.{n}" for n in (*names, "absent")]), "stats")
    there = {n: tables.table_exists(spark, f"{database}.{n}") for n in (*names, "absent")}
    spark.sql(f"DROP DATABASE {database} CASCADE")
    exists = F.create_map(*[F.lit(x) for pair in there.items() for x in pair])
    short = F.element_at(F.split("table_name", "[.]"), 2)
    return found.select(short.alias("name"), "row_count", F.col("column_count").cast("int").alias("column_count"), exists[short].alias("found"))


@_query
def table_merge(spark, folder):
    """Orders stored by status, then changed in place: only touched partitions
    are rewritten, and a row may move to another one."""
    old, new = _order_versions(spark, folder)
    path = scratch_path(spark, "orders")
    name = "orders_" + path[-12:]
    sinks.write_table(old, name, partition_by=["o_orderstatus"], location=path)
    sinks.write_table(new, name, "merge", partition_by=["o_orderstatus"], keys=["o_orderkey"])
    return _read_and_forget(spark, name)


@_query
def table_merge_nulls(spark, folder):
    """Some orders lie in the partition of null; the merge finds the partitioning itself."""
    old, new = _order_versions(spark, folder)
    status = F.nullif("o_orderstatus", F.lit("O"))
    path = scratch_path(spark, "orders")
    name = "orders_" + path[-12:]
    sinks.write_table(old.withColumn("o_orderstatus", status), name, partition_by=["o_orderstatus"], location=path)
    sinks.write_table(new.withColumn("o_orderstatus", status), name, "merge", keys=["o_orderkey"])
    return _read_and_forget(spark, name)


def _read_and_forget(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a table, whose catalog entry is dropped."""
    rows = settle(tables.read_table(spark, name), "read")
    spark.sql(f"DROP TABLE {name}")
    return rows


@_query
def table_append(spark, folder):
    """Customers stored, then suppliers with another column appended."""
    path = scratch_path(spark, "parties")
    name = "parties_" + path[-12:]
    customers = table(spark, folder, "customer").select(F.col("c_name").alias("name"), "c_mktsegment")
    suppliers = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), "s_acctbal")
    sinks.write_table(customers, name, location=path)
    sinks.write_table(suppliers, name, "append")
    return _read_and_forget(spark, name)


@_query
def snapshot_diff(spark, folder):
    old, new = _order_versions(spark, folder)
    after = changes.upsert(old, new, ["o_orderkey"]).filter("o_orderpriority <> '5-LOW'")
    return changes.snapshot_diff(old, after, ["o_orderkey"])


@_query
def snapshot_diff_columns(spark, folder):
    """One column has gone and another has come between the versions."""
    old, new = _order_versions(spark, folder)
    before = old.drop("o_orderpriority")
    after = changes.upsert(old, new, ["o_orderkey"]).drop("o_totalprice")
    return changes.snapshot_diff(before, after, ["o_orderkey"])


@_query
def append_evolving(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_name").alias("name"), "c_mktsegment")
    suppliers = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), "s_acctbal")
    return changes.append_evolving(customers, suppliers)


@_query
def key_check(spark, folder):
    return quality.key_check(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query
def repeated_keys(spark, folder):
    return quality.repeated_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def _line_rules() -> quality.Rules:
    return {
        "quantity_up_to_45": F.col("l_quantity") <= 45,
        "taxed": F.col("l_tax") > 0,
        "finished": F.col("l_linestatus") == "F",
    }


@_query
def quarantine(spark, folder):
    return quality.quarantine(table(spark, folder, "lineitem"), _line_rules())


@_query
def line_rule_counts(spark, folder):
    return quality.rule_counts(table(spark, folder, "lineitem"), _line_rules())


@_query
def valid_lines(spark, folder):
    return quality.keep_valid(table(spark, folder, "lineitem"), _line_rules())


@_query
def table_counts(spark, folder):
    names = (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations",
    )
    return tables.table_counts({n: table(spark, folder, n) for n in names})


@_query
def bounded_read(spark, folder):
    """A table read with a limit of rows has so many."""
    path = scratch_path(spark, "orders")
    name = "orders_" + path[-12:]
    sinks.write_table(table(spark, folder, "orders"), name, location=path)
    rows = settle(tables.read_table(spark, name, {"o_orderstatus": "F"}, limit=100), "read")
    spark.sql(f"DROP TABLE {name}")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("rows"))


@_query
def free_sql(spark, folder):
    view = "orders_" + scratch_path(spark, "view")[-12:]
    table(spark, folder, "orders").createOrReplaceTempView(view)
    query = f"SELECT o_custkey, sum(o_totalprice) > :least AS large, count(*) AS orders FROM {view} GROUP BY o_custkey"
    rows = tables.run_sql(spark, query, {"least": 1_000_000})
    spark.catalog.dropTempView(view)
    return rows


@_query
def filtered_read(spark, folder):
    orders = table(spark, folder, "orders")
    return tables.matching(orders, {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]})


# ---- streams ------------------------------------------------------------------


def _observation_stream(spark: SparkSession, folder: str) -> DataFrame:
    dims = [table(spark, folder, n) for n in ("part", "supplier", "nation")]
    schema = table(spark, folder, "lineitem").schema
    # a glob, because a streaming source takes a single file only by pattern;
    # it matches a table stored as a folder of files as well
    path = f"{folder}/lineitem.parque[t]"
    return from_lines(ingest.file_stream(spark, path, schema, file_format="parquet"), *dims)


@_query
def stream_silver(spark, folder):
    rows = silver_stream(_observation_stream(spark, folder))
    out = scratch_path(spark, "silver")
    ingest.drain(rows, scratch_path(spark, "offsets"), path=out)
    return spark.read.schema(rows.schema).parquet(out)


@_query
def stream_dedupe(spark, folder):
    rows = dedupe_stream(silver_stream(_observation_stream(spark, folder))).select(
        *quality.PRICE_IDENTITY
    )
    out = scratch_path(spark, "deduped")
    ingest.drain(rows, scratch_path(spark, "offsets"), path=out)
    return spark.read.schema(rows.schema).parquet(out)


@_query
def stream_unique(spark, folder):
    rows = silver_stream(_observation_stream(spark, folder))
    out = scratch_path(spark, "unique")
    drain_unique(rows, out, scratch_path(spark, "offsets"))
    return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)


@_query
def stream_gold(spark, folder):
    rows = silver_stream(_observation_stream(spark, folder))
    silver_path, gold_path = scratch_path(spark, "silver"), scratch_path(spark, "gold")
    ingest.drain(rows, scratch_path(spark, "offsets"), path=silver_path, partition_by=gold.MONTH, ids=["price_id"])
    follow = ingest.file_stream(spark, silver_path, rows.schema, file_format="parquet")
    gold.drain_gold(spark, follow, silver_path, gold_path, scratch_path(spark, "offsets"))
    return spark.read.parquet(gold_path)


def _files_of_a_drop(spark: SparkSession, folder: str, source: str, drops: int) -> int:
    """Files that one of ``drops`` parts of a table's rows is dealt over: one, for small tables."""
    return max(1, -(-table(spark, folder, source).count() // (drops * FILE_ROWS)))


def _dropping_box(spark: SparkSession, folder: str, rows: DataFrame, source: str = "lineitem") -> tuple[str, int]:
    """Rows dealt over six drops, as a stream finds them one after the other, and the files of a drop."""
    inbox, files_each = scratch_path(spark, "inbox"), _files_of_a_drop(spark, folder, source, 6)
    _write_dealt(rows, 6 * files_each, inbox)
    return inbox, files_each


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows that took a shuffle, written once and closely, so that the next shuffle doesn't lie beside it."""
    path = scratch_path(rows.sparkSession, name)
    with freed(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _write_dealt(rows: DataFrame, files_all: int, inbox: str) -> None:
    """Appends rows to an inbox in so many files; price ids go there as bytes."""
    ids = ["price_id"] if "price_id" in rows.columns else []
    with freed(rows.sparkSession):
        dealt = unpack_ids(pack_ids(rows, ids).repartition(files_all), ids)
        dealt.write.mode("append").option("compression", "zstd").parquet(inbox)


def _some_twice(rows: DataFrame, which: str) -> DataFrame:
    """All rows, and those of a condition once more; the rows are computed once."""
    copies = F.when(F.expr(which), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).drop("_copy")


def _with_null_varieties(spark: SparkSession, folder: str) -> DataFrame:
    return price_observations(spark, folder).withColumn("variety", F.nullif("variety", F.lit("A")))


@_query
def stream_unique_batches(spark, folder):
    """Several batches, a third of the rows twice, some keys with a null."""
    rows = _stored(price_plan.silver(_with_null_varieties(spark, folder), deduplicate=True), "silver")
    inbox, each = _dropping_box(spark, folder, _some_twice(rows, "grade = 'F'"))
    arriving = ingest.file_stream(spark, inbox, rows.schema, file_format="parquet", max_files=2 * each)
    out = scratch_path(spark, "unique")
    drain_unique(arriving, out, scratch_path(spark, "offsets"))
    return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)


@_query
def stream_gold_batches(spark, folder):
    """Silver and gold tables that each grow over several batches."""
    rows = price_plan.silver(price_observations(spark, folder))
    inbox, each = _dropping_box(spark, folder, rows)
    silver_path, gold_path = scratch_path(spark, "silver"), scratch_path(spark, "gold")
    arriving = ingest.file_stream(spark, inbox, rows.schema, file_format="parquet", max_files=2 * each)
    ingest.drain(arriving, scratch_path(spark, "offsets"), path=silver_path, partition_by=gold.MONTH, ids=["price_id"])
    follow = ingest.file_stream(spark, silver_path, rows.schema, file_format="parquet", max_files=40)
    gold.drain_gold(spark, follow, silver_path, gold_path, scratch_path(spark, "offsets"))
    return spark.read.parquet(gold_path)


@_query
def stream_unique_empty_first(spark, folder):
    """The first drop has no valid row."""
    rows = _stored(price_plan.silver(price_observations(spark, folder), deduplicate=True), "silver")
    inbox = scratch_path(spark, "inbox")
    each = _files_of_a_drop(spark, folder, "lineitem", 3)
    bad = settle(rows.limit(1).withColumn("modal_price", F.lit(0.0)).coalesce(1), "bad")
    for _ in range(each):  # so that the first drop has no other file
        bad.write.mode("append").parquet(inbox)
    _write_dealt(rows, 3 * each, inbox)
    arriving = ingest.file_stream(spark, inbox, rows.schema, file_format="parquet", max_files=each)
    out = scratch_path(spark, "unique")
    drain_unique(quality.valid_prices(arriving), out, scratch_path(spark, "offsets"))
    return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)


@_query
def stream_gold_states(spark, folder):
    """Gold kept as states: every batch adds its own, and every third merges them."""
    rows = price_plan.silver(price_observations(spark, folder))
    inbox, each = _dropping_box(spark, folder, rows)
    arriving = ingest.file_stream(spark, inbox, rows.schema, file_format="parquet", max_files=each)
    path = scratch_path(spark, "states")
    gold_states.drain_states(arriving, path, scratch_path(spark, "offsets"), compact_every=3)
    return gold_states.read_gold(spark, path)


@_query
def stream_survivors(spark, folder):
    """Of every identity the row of the smallest id, in whatever batch it comes."""
    rows = price_plan.silver(_with_null_varieties(spark, folder))
    inbox, each = _dropping_box(spark, folder, _some_twice(rows, "grade = 'F'"))
    arriving = ingest.file_stream(spark, inbox, rows.schema, file_format="parquet", max_files=2 * each)
    out = scratch_path(spark, "survivors")
    drain_survivors(arriving, out, scratch_path(spark, "offsets"))
    return read_survivors(spark, out, rows.schema)


@_query
def stream_rule_counts(spark, folder):
    """The rules' counts as a stream's batches gave them, added up."""
    rows = _odd_prices(spark, folder)
    inbox, each = _dropping_box(spark, folder, rows)
    arriving = ingest.file_stream(spark, inbox, rows.schema, file_format="parquet", max_files=2 * each)
    path, out = scratch_path(spark, "metrics"), scratch_path(spark, "valid")
    listener = metrics.RuleMetrics(spark, path)
    spark.streams.addListener(listener)
    try:
        ingest.drain(metrics.watch_rules(arriving, quality.price_rules()), scratch_path(spark, "offsets"), path=out)
        listener.wait()
    finally:
        spark.streams.removeListener(listener)
    return metrics.metrics_by_rule(metrics.stored_metrics(spark, path))


def _odd_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of which some have no price, no date or no commodity."""
    rows = price_observations(spark, folder)
    return rows.withColumns(
        {
            "modal_price": F.when(F.col("variety") != "R", F.col("modal_price")),
            "arrival_date": F.when(F.col("grade") != "O", F.col("arrival_date")),
            "commodity": F.when(F.col("commodity") == "Brand#13", F.lit(" ")).otherwise(F.col("commodity")),
        }
    )


@_query
def valid_rows_observed(spark, folder):
    """What is kept and what the rules saw, from the same job."""
    kept, seen = quality.keep_valid_observed(_odd_prices(spark, folder), quality.price_rules())
    rows = settle(kept, "valid").count()
    counts = seen.get
    found = [(name, counts["rows"], counts[name], rows) for name in quality.price_rules()]
    return spark.createDataFrame(found, "rule string, rows long, failed long, kept long")


@_query
def stream_dedupe_events(spark, folder):
    """Events that come twice, in other files, within the delay."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    inbox, each = _dropping_box(spark, folder, _some_twice(events, "event_type = 'click'"), "events")
    arriving = ingest.file_stream(spark, inbox, events.schema, file_format="parquet", max_files=2 * each)
    rows = dedupe_stream(arriving, ["event_id"], day="ts", delay="60 days")
    out = scratch_path(spark, "events")
    ingest.drain(rows, scratch_path(spark, "offsets"), path=out)
    return spark.read.schema(rows.schema).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---- a report for one selection --------------------------------------------------


def _report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return report.price_report(price_observations(spark, folder), commodity="Brand#13")[name]


@_query
def report_trend(spark, folder):
    return _report(spark, folder, "trend")


@_query
def report_forecast(spark, folder):
    return _report(spark, folder, "forecast")


@_query
def report_outlook(spark, folder):
    return _report(spark, folder, "outlook")


@_query
def report_current_prices(spark, folder):
    return _report(spark, folder, "current_prices")


# ---- price model --------------------------------------------------------------


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Test predictions of the price model."""
    rows = model.training_rows(price_plan.enriched(price_observations(spark, folder)))
    narrow = rows.select("price_id", "arrival_date", *model.CATEGORIES, *model.AVERAGES, *model.CALENDAR, model.LABEL)
    train, test = model.split(settle(narrow, "training"))
    predicted = model.fit(train).transform(test)
    return predicted.select("commodity", "market", "arrival_date", model.LABEL, "prediction")


@_query
def price_model_eval(spark, folder):
    return model.evaluate(_predictions(spark, folder))


@_query
def error_by_commodity(spark, folder):
    return model.error_by_commodity(_predictions(spark, folder))


@_query
def model_residuals(spark, folder):
    return model.residuals(_predictions(spark, folder))


def _average_as_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """The seven-row average taken as the prediction: metrics SQL can follow."""
    rows = price_plan.enriched(price_observations(spark, folder))
    return model.training_rows(rows).withColumn("prediction", F.col("moving_avg_7d"))


@_query
def average_eval(spark, folder):
    metrics = model.evaluate(_average_as_prediction(spark, folder))
    return metrics.select("samples", *[half_up(c, 4).alias(c) for c in ("rmse", "mae", "r2")])


@_query
def average_error_by_commodity(spark, folder):
    errors = model.error_by_commodity(_average_as_prediction(spark, folder))
    return errors.select("commodity", "samples", *[half_up(c, 4).alias(c) for c in ("rmse", "mae")])


@_query
def average_residuals(spark, folder):
    return model.residuals(_average_as_prediction(spark, folder))


@_query
def lagged_features(spark, folder):
    valid = quality.valid_prices(price_observations(spark, folder))
    clean = price_plan.clean_series(valid, [*windows.SERIES, "arrival_date", "variety"], windows.SERIES, windows.ROWS_PER_PIECE)
    return windows.with_lagged_averages(*clean).select(
        "price_id", "lagged_avg_7d", "lagged_avg_30d"
    )


@_query
def model_features(spark, folder):
    rows = model.training_rows(price_plan.enriched(price_observations(spark, folder)))
    found = model.features(settle(rows, "training"))
    indexes = [f"{c}_idx" for c in model.CATEGORIES]
    names = [c for c in found.columns if c.endswith("_std")]
    return found.select("price_id", *indexes, *[F.round(c, 4).alias(c) for c in names])


@_query
def model_split(spark, folder):
    rows = price_observations(spark, folder)
    train, test = model.split(rows)
    return train.select("price_id", F.lit("train").alias("part")).union(test.select("price_id", F.lit("test").alias("part")))


@_query
def tree_stump(spark, folder):
    """One tree of one split, on columns of few values: what SQL can follow."""
    rows = price_observations(spark, folder).select(
        F.dayofweek("arrival_date").cast("double").alias("weekday"),
        F.month("arrival_date").cast("double").alias("month"),
        F.least(F.floor(F.col("min_price") / 20000), F.lit(4)).cast("double").alias("level"),
        F.col("modal_price"),
    )
    return model.stump(settle(rows, "binned"), ("weekday", "month", "level"))


@_query
def text_weights(spark, folder):
    """The non-zero places of the hashed text vectors."""
    return term_weights(_texts(spark, folder)).select("chunk_id", "place", F.round("weight", 5).alias("weight"))
