"""The relations of the engine."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

RECORD_COLUMNS = ["keyword", "ref_type", "usage_type", "filepath", "lineno", "code", "src_var", "src_file", "src_lineno"]
#: The nine columns of a result; all strings, none null.
RECORD = StructType([StructField(n, StringType(), False) for n in RECORD_COLUMNS])
HITS = StructType([StructField("keyword", StringType()), StructField("value", StringType())])
LINES = StructType([StructField("filepath", StringType()), StructField("lineno", IntegerType()), StructField("line", StringType())])
STATS = StructType([StructField("keyword", StringType()), *[StructField(n, LongType()) for n in ("total", "valid", "skipped")]])

# Kinds of reference and headers of a result file.
DIRECT, INDIRECT, GETTER, SETTER = "直接", "間接", "間接（getter経由）", "間接（setter経由）"
HEADERS = ["文言", "参照種別", "使用タイプ", "ファイルパス", "行番号", "コード行", "参照元変数名", "参照元ファイル", "参照元行番号"]
OTHER = "その他"
