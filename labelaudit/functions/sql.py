"""The parsers as SQL functions, for queries written in SQL. Spark inlines them: no Python runs.

They take texts that label_text has normalised.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from labelaudit.functions import fixed_values as V


def _first(regex: str, group: int) -> str:
    return f"nullif(regexp_extract(t, r'{V.FLAGS}{regex}', {group}), '')"


def _number(text: str) -> str:
    plain = rf"regexp_replace(replace({text}, ',', ''), r'\.(?=.*\.)', '')"
    return f"try_cast({plain} AS DECIMAL(14,4))"


def definitions() -> dict[str, tuple[str, str]]:
    """Name -> (type of the result, expression over t)."""
    return {
        "label_text": ("STRING", r"nullif(trim(regexp_replace(replace(replace(replace(t, '²', '2'), '³', '3'), '₨', 'Rs'), r'(?U)[\s\x1c-\x1f]+', ' ')), '')"),
        "label_quantity": ("DECIMAL(14,4)", _number(_first(V.QUANTITY, 1))),
        "label_quantity_unit": ("STRING", f"lower({_first(V.QUANTITY, 2)})"),
        "label_money": ("DECIMAL(14,4)", _number(_first(V.MONEY, 1))),
        "label_unit_price": ("DECIMAL(14,4)", _number(_first(V.UNIT_PRICE, 1))),
        "label_prohibited_unit": ("STRING", _first(V.PROHIBITED_UNIT, 1)),
        "label_phone": ("STRING", _first(V.PHONE, 0)),
        "label_email": ("STRING", _first(V.EMAIL, 0)),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; their names."""
    for name, (kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return list(definitions())
