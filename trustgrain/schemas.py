"""Fixed schemas of the review data model."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEWS = T.StructType(
    [
        T.StructField("product_id", T.StringType(), False),
        T.StructField("review_idx", T.LongType(), False),
        T.StructField("review_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("date_raw", T.StringType()),
    ]
)

#: What a page or an API body yields per review.
EXTRACTED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("review_id", T.StringType()),
        T.StructField("date", T.StringType()),
    ]
)

PRODUCT_META = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("overall_rating", T.DoubleType()),
        T.StructField("platform", T.StringType()),
    ]
)

RAW_REVIEW_CSV = "review_text STRING, rating STRING, date STRING"

#: One element of the JSON request body ``{"reviews": [...]}``.
REVIEW_BODY = (
    "reviews ARRAY<STRUCT<text: STRING, rating: DOUBLE, date: STRING, sentiment: STRING, confidence: DOUBLE, "
    "predictedRating: INT, aiGeneratedProbability: DOUBLE, authenticityScore: DOUBLE>>"
)

FLAG = "STRUCT<type: STRING, severity: STRING, description: STRING, evidence: STRING>"
