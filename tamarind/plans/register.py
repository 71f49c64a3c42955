"""Register the library's functions for use from SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tamarind.functions import numeric, text, web
from tamarind.sources.readers import parse_csv


def register(spark: SparkSession) -> list[str]:
    """Names of the functions that SQL can call afterwards."""

    @F.pandas_udf("double")
    def quantile(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([numeric.beta_quantile(x, y, z) for x, y, z in zip(q, a, b, strict=True)], dtype="float64")

    @F.udtf(returnType="kind string, value string, confidence double, placement string")
    class PageContacts:
        def eval(self, html: str):
            yield from web.contacts(html)

    @F.udtf(returnType="row_no int, cells map<string,string>")
    class CsvRows:
        def eval(self, content: str):
            yield from enumerate(parse_csv(content or "")[0])

    scalars = {
        "match_key": text.match_key_udf, "normalize_text": text.normalize_udf, "jaro_winkler": text.jaro_winkler_udf, "canonical_url": web.canonical_url_udf,
        "profile_handle": web.handle_udf, "text_corpus": web.text_corpus_udf, "beta_quantile": quantile,
    }
    for name, f in scalars.items():
        spark.udf.register(name, f)
    tables = {"page_contacts": PageContacts, "csv_rows": CsvRows}
    for name, f in tables.items():
        spark.udtf.register(name, f)
    return [*scalars, *tables]
