"""Fixed schemas of the logical tables (the declared-DDL side of the model)."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("order_ts", T.TimestampNTZType(), True),
    T.StructField("dt", T.DateType(), True),
    T.StructField("product", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("total_amount", T.DecimalType(18, 2), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("discount_applied", T.BooleanType(), True),
])

SOCIAL_SENTIMENT = T.StructType([
    T.StructField("date", T.DateType(), True),
    T.StructField("product", T.StringType(), True),
    T.StructField("sentiment", T.DoubleType(), True),
])

TRENDS = T.StructType([
    T.StructField("date", T.DateType(), True),
    T.StructField("product", T.StringType(), True),
    T.StructField("interest", T.IntegerType(), True),
])

FORECAST = T.StructType([
    T.StructField("product", T.StringType(), True),
    T.StructField("ds", T.DateType(), True),
    T.StructField("yhat", T.DoubleType(), True),
    T.StructField("yhat_lower", T.DoubleType(), True),
    T.StructField("yhat_upper", T.DoubleType(), True),
])

CATALOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("old_price", T.DoubleType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("image", T.StringType(), True),
    T.StructField("stock", T.IntegerType(), True),
    T.StructField("rating", T.DoubleType(), True),
    T.StructField("short_desc", T.StringType(), True),
    T.StructField("tags", T.ArrayType(T.StringType()), True),
    T.StructField("eta_days", T.IntegerType(), True),
])

CHAT_MESSAGE = T.StructType([
    T.StructField("conv_id", T.LongType(), True),
    T.StructField("turn", T.LongType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
])

# Daily export sheet as written by the CSV sink (S4) and read back (S3).
DAILY_SALES = T.StructType([
    T.StructField("dt", T.DateType(), True),
    T.StructField("product", T.StringType(), True),
    T.StructField("quantity", T.LongType(), True),
    T.StructField("price", T.DoubleType(), True),
])
