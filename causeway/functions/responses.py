"""Reading JSON out of model responses, without ever failing a row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BLANK = " \n\r\t\f\v"


def unfenced(response: Column) -> Column:
    """Response without code fences at line starts and ends."""
    body = F.btrim(response, F.lit(_BLANK))
    body = F.regexp_replace(body, r"(?m)^```(json)?|```$", "")
    return F.btrim(body, F.lit(_BLANK))


def json_payload(response: Column) -> Column:
    """JSON value of a response as VARIANT: the whole text, else its outermost braces.

    Null where neither parses. Values that are not objects are kept; reading a field
    from them gives null, so they behave like an empty answer.
    """
    body = unfenced(response)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(braces))


def parse_error(response: Column) -> Column:
    """Why a response cannot be used, null if it can."""
    payload = json_payload(response)
    return (
        F.when(response.isNull() | (F.btrim(response, F.lit(_BLANK)) == ""), "empty")
        .when(payload.isNull(), "not json")
        .when(~F.schema_of_variant(payload).startswith("OBJECT"), "not an object")
    )


def text_field(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", "string")


def number_field(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", "double")


def text_list(payload: Column, name: str) -> Column:
    """A list of strings; null if the field is missing or not a list."""
    return F.try_variant_get(payload, f"$.{name}", "array<string>")


def object_list(payload: Column, name: str) -> Column:
    """A list of JSON values; null if the field is missing or not a list."""
    return F.try_variant_get(payload, f"$.{name}", "array<variant>")
