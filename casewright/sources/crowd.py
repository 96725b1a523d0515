"""Crowd-label result sheets: fixed schema, kept columns, one image column found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.text import missing_columns
from casewright.functions.timeutil import named_zones
from casewright.operators.labels import batch_id, find_column

#: The columns of a result sheet and those that are kept.
COLUMNS = (
    "HITId", "HITTypeId", "Title", "Description", "Keywords", "Reward", "CreationTime", "MaxAssignments", "RequesterAnnotation",
    "AssignmentDurationInSeconds", "AutoApprovalDelayInSeconds", "Expiration", "NumberOfSimilarHITs", "LifetimeInSeconds", "AssignmentId",
    "WorkerId", "AssignmentStatus", "AcceptTime", "SubmitTime", "AutoApprovalTime", "ApprovalTime", "RejectionTime", "RequesterFeedback",
    "WorkTimeInSeconds", "LifetimeApprovalRate", "Last30DaysApprovalRate", "Last7DaysApprovalRate", "Input.image_url", "Approve", "Reject",
)
KEPT = ("HITId", "HITTypeId", "Reward", "AssignmentId", "WorkerId", "AcceptTime", "SubmitTime", "WorkTimeInSeconds", "Approve", "Reject", "Input.image_url")
IMAGE = ".pngImageData"
_TIME = "EEE MMM dd HH:mm:ss VV yyyy"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The kept columns, the image column as ``image_base64``, the batch number and UTC times.

    A sheet without a required column or without an image column is refused.
    """
    header = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    if absent := missing_columns(header.columns, list(COLUMNS)):
        raise ValueError(f"missing columns: {absent}")
    image = find_column(header.columns, IMAGE)
    quoted = lambda c: F.col(f"`{c}`")
    sheet = header.select(*(quoted(c).alias(c.replace(".", "_")) for c in KEPT), quoted(image).alias("image_base64"))
    # Day names are not part of the modern pattern's strict parsing, so they are cut off.
    moment = lambda c: F.try_to_timestamp(named_zones(F.regexp_replace(c, r"^\w{3} ", "")), F.lit(_TIME.removeprefix("EEE ")))
    return sheet.withColumns({"AcceptTime": moment("AcceptTime"), "SubmitTime": moment("SubmitTime"), "batch": batch_id(F.input_file_name())})


