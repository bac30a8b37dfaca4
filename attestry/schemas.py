"""Schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


USER_IDENTITY = strings("userName", "principalId", "arn", "type")

OBJECT_COLUMNS = [
    "eventTime", "eventName", "eventSource", "awsRegion", "sourceIpAddress", "userAgent",
    "userIdentityType", "principalId", "userIdentityArn", "sessionIssuerUserName",
    "recipientAccountId", "requestID", "reqBucketName", "reqObjectKey",
]
CURATED_COLUMNS = [
    "eventTime", "eventName", "auth_display_name", "db_username", "database", "path",
    "lease_id", "sourceIpAddress", "userAgent",
]
OPTIONAL_COLUMNS = [
    "user", "userName", "user_email", "email", "userEmail", "human_id", "resourceArn",
    "auth_method", "auth_identity", "errorCode", "errorMessage", "client_addr", "remote_address",
    "accessKeyId", "eventID",
]
EVENT_COLUMNS = list(dict.fromkeys(OBJECT_COLUMNS + CURATED_COLUMNS + OPTIONAL_COLUMNS))

RAW_OBJECT_EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "eventTime", "eventName", "eventSource", "eventCategory", "awsRegion", "sourceIpAddress", "userAgent",
        "recipientAccountId", "requestID")]
    + [
        T.StructField("userIdentity", T.StructType([
            *strings("type", "principalId", "arn", "userName").fields,
            T.StructField("sessionContext", T.StructType([
                T.StructField("sessionIssuer", strings("userName"))])),
        ])),
        T.StructField("requestParameters", T.MapType(T.StringType(), T.StringType())),
    ]
)
RAW_CURATED_EVENT = T.StructType([
    T.StructField("eventTime", T.StringType()),
    T.StructField("eventData", T.StructType([
        T.StructField("eventName", T.StringType()),
        T.StructField("additionalEventData", T.MapType(T.StringType(), T.StringType())),
    ])),
])
ACCESS_REQUEST = T.StructType([
    *strings("request_id", "timestamp", "local_date", "user_id", "user_name", "user_email", "jira_issue_id",
             "justification").fields,
    T.StructField("duration_minutes", T.IntegerType()),
    *strings("request_timestamp", "expiry_timestamp").fields,
    T.StructField("ttl", T.LongType()),
])
DELIVERY = T.StructType([T.StructField("awslogs", strings("data"))])
DELIVERY_PAYLOAD = T.StructType([
    *strings("messageType", "owner", "logGroup", "logStream").fields,
    T.StructField("logEvents", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("timestamp", T.LongType()),
        T.StructField("message", T.StringType())]))),
])
LISTING_PAGE = T.StructType([
    T.StructField("page_no", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("results", T.StructType([
        T.StructField("data", T.ArrayType(strings("id", "externalId", "name", "title", "url", "fileName"))),
        T.StructField("pageInfo", T.StructType([
            T.StructField("hasNextPage", T.BooleanType()), T.StructField("endCursor", T.StringType())])),
    ])),
])
EVIDENCE_ROW = strings("family", "control", "source_type", "link", "status", "doc_type")
