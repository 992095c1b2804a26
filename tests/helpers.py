from pyspark.sql import types as T

PAGE_SCHEMA = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()),
                                                        T.StructField("text", T.StringType())]))),
    T.StructField("code_blocks", T.ArrayType(T.StructType([T.StructField("language", T.StringType()),
                                                           T.StructField("code", T.StringType())]))),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("has_tables", T.BooleanType()),
])


def page(site="s", ord=0, url=None, title="Topic", description=None, content="", headings=(), code=(), links=(),
         has_tables=False):
    url = url or f"https://{site}.example.com/docs/p{ord}"
    return (site, ord, url, title, description, content,
            [(2, h) if isinstance(h, str) else h for h in headings],
            [(None, c) if isinstance(c, str) else c for c in code], list(links), has_tables)


def pages_df(spark, rows):
    return spark.createDataFrame(rows, PAGE_SCHEMA)


def rules_by_id(df):
    return {r["rule_id"]: r for r in df.collect()}
