"""Table schemas with column comments.

The comments are kept as column metadata, so they reach the catalog with every
``saveAsTable``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, NUMBER, DAY, WHOLE, MOMENT = (
    T.StringType(), T.DoubleType(), T.DateType(), T.IntegerType(), T.TimestampType(),
)
LIST = T.ArrayType(T.StringType())


def _table(*columns: tuple[str, T.DataType, str]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True, {"comment": c}) for n, t, c in columns])


_SOURCE_FILE = ("source_file", TEXT, "File the row was read from")

RAW_PRICES = _table(
    ("price_id", TEXT, "Key of the observation, a hash of its natural key"),
    ("state", TEXT, "State of the market"),
    ("district", TEXT, "District of the market"),
    ("market", TEXT, "Name of the market"),
    ("commodity", TEXT, "Traded commodity"),
    ("variety", TEXT, "Variety of the commodity"),
    ("grade", TEXT, "Quality grade"),
    ("arrival_date", DAY, "Day the price was recorded"),
    ("min_price", NUMBER, "Lowest wholesale price per quintal"),
    ("max_price", NUMBER, "Highest wholesale price per quintal"),
    ("modal_price", NUMBER, "Most frequent wholesale price per quintal"),
    _SOURCE_FILE,
)

CALENDAR = _table(
    ("year", WHOLE, "Year of arrival_date"),
    ("month", WHOLE, "Month of arrival_date, 1 to 12"),
    ("day_of_week", WHOLE, "Day of week of arrival_date, 1 = Sunday"),
)

INDICATORS = _table(
    ("price_change_pct", NUMBER, "Change against the previous row of the series, percent"),
    ("moving_avg_7d", NUMBER, "Mean modal price of the last 7 rows"),
    ("moving_avg_30d", NUMBER, "Mean modal price of the last 30 rows"),
    ("volatility_7d", NUMBER, "Sample standard deviation of the last 7 rows"),
)

SILVER_PRICES = T.StructType(RAW_PRICES.fields + CALENDAR.fields)
ENRICHED_PRICES = T.StructType(SILVER_PRICES.fields + INDICATORS.fields)

SCHEMES = _table(
    ("scheme_id", TEXT, "Key of the scheme"),
    ("name", TEXT, "Short name"),
    ("name_en", TEXT, "Full English name"),
    ("category", TEXT, "Kind of support"),
    ("description", TEXT, "What the scheme is about"),
    ("eligibility", LIST, "Conditions an applicant has to meet"),
    ("exclusion_criteria", TEXT, "Who cannot apply"),
    ("benefits", TEXT, "What an applicant receives"),
    ("how_to_apply", TEXT, "Steps of the application"),
    ("documents_required", LIST, "Papers to hand in"),
    ("official_url", TEXT, "Web page of the scheme"),
    ("helpline", TEXT, "Telephone number"),
    ("coverage", TEXT, "Where the scheme applies"),
    _SOURCE_FILE,
)

KNOWLEDGE = _table(
    ("disease_class", TEXT, "Class label, Crop___Disease_name"),
    ("crop", TEXT, "Crop part of the label"),
    ("disease_name", TEXT, "Disease part of the label"),
    ("treatment", TEXT, "What to do against the disease"),
    ("prevention", TEXT, "How to avoid it"),
    ("organic", TEXT, "Organic option"),
    _SOURCE_FILE,
)

GUIDE = _table(
    ("crop", TEXT, "Crop the product is for"),
    ("growth_stage", TEXT, "Growth stage of the crop"),
    ("category", TEXT, "Kind of product"),
    ("problem", TEXT, "Problem it solves"),
    ("product_name", TEXT, "Product"),
    ("dosage", TEXT, "Amount to apply"),
    ("application_method", TEXT, "How to apply it"),
    ("timing", TEXT, "When to apply it"),
    ("precautions", TEXT, "Safety notes"),
    ("organic_alternative", TEXT, "Organic option"),
    ("cost_estimate", TEXT, "Approximate cost"),
    _SOURCE_FILE,
)

DISEASE_LOG = _table(
    ("prediction_id", TEXT, "Key of the log row"),
    ("timestamp", MOMENT, "When it was logged"),
    ("predicted_disease", TEXT, "Predicted class label"),
    ("predicted_crop", TEXT, "Crop part of the label"),
    ("confidence", NUMBER, "Score of the label"),
    ("treatment", TEXT, "Treatment shown"),
    ("model_version", TEXT, "Version of the model"),
    ("user_language", TEXT, "Language code of the user"),
)

PRICE_LOG = _table(
    ("prediction_id", TEXT, "Key of the log row"),
    ("timestamp", MOMENT, "When it was logged"),
    ("commodity", TEXT, "Commodity"),
    ("market", TEXT, "Market"),
    ("state", TEXT, "State"),
    ("predicted_price", NUMBER, "Forecast price"),
    ("days_ahead", WHOLE, "Days after the last observation"),
    ("model_version", TEXT, "Version of the model"),
)

CHAT_LOG = _table(
    ("session_id", TEXT, "Key of the log row"),
    ("timestamp", MOMENT, "When it was logged"),
    ("user_query", TEXT, "Question"),
    ("intent", TEXT, "Intent found"),
    ("response_summary", TEXT, "Start of the answer"),
    ("language", TEXT, "Language code"),
    ("feature_used", TEXT, "Feature that answered"),
)

LOGS = {
    "disease_predictions_log": DISEASE_LOG,
    "price_predictions_log": PRICE_LOG,
    "chat_sessions": CHAT_LOG,
}


def with_comments(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Attach the comments of ``schema`` to the columns of the same name."""
    comments = {f.name: f.metadata for f in schema.fields}
    return df.select(
        *[
            F.col(c).alias(c, metadata=comments[c]) if c in comments else F.col(c)
            for c in df.columns
        ]
    )
