"""Service replies (JSON) to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assemble import element_pages

_NAMES = ("md_content", "markdown", "md", "full_md")


def _string(v: Column, path: str) -> Column:
    """A non-empty string at a path; null where there is anything else."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    return F.when((F.length(text) > 0) & (kind == "STRING"), text)  # in this order: most fields aren't there


def reply_markdown(v: Column) -> Column:
    """The first non-empty string of the known fields, at the top or under result; else empty."""
    return F.coalesce(*(_string(v, f"$.{at}{n}") for at in ("", "result.") for n in _NAMES), F.lit(""))


def _lists(v: Column, reply: Column) -> Column:
    """The list of elements: at each level content_list, then content_list_v2, whichever first begins with an object or a list; else
    the same one result deeper, as far as results go."""

    def here(at: Column, result: str = "") -> Column:
        found = []
        for name in ("content_list", "content_list_v2"):
            kind = F.schema_of_variant(F.try_variant_get(at, f"$.{result}{name}[0]", "variant"))
            found.append(F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.try_variant_get(at, f"$.{result}{name}", "array<variant>")))
        return F.coalesce(*found)

    none = F.lit(None).cast("array<variant>")
    # a level deeper needs a key, which is written as such or with an escape
    levels = F.sequence(F.lit(0), F.coalesce(F.regexp_count(reply, F.lit('"result"|\\\\u')), F.lit(0)))
    step = lambda acc, _: F.struct(F.try_variant_get(acc["at"], "$.result", "variant").alias("at"), F.coalesce(acc["found"], here(acc["at"])).alias("found"))
    # nearly all lists are at the first two levels, for which code is compiled; a fold is interpreted
    return F.coalesce(here(v), here(v, "result."), F.aggregate(levels, F.struct(v.alias("at"), none.alias("found")), step, lambda acc: acc["found"]))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _objects(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    """keys, the reply's Markdown (whole) and its elements in their order (_o: outer, the place of the list that has it, and x)."""
    parsed = replies.select(*keys, F.col(reply).alias("_r"), F.try_parse_json(F.col(reply)).alias("_v"))
    lists = parsed.select(*keys, reply_markdown(F.col("_v")).alias("whole"), _lists(F.col("_v"), F.col("_r")).alias("_l"))
    one = lambda outer, x: F.struct(outer.cast("int").alias("outer"), x.alias("x"))
    of = lambda e, i: F.transform(F.filter(F.try_variant_get(e, "$", "array<variant>"), lambda x: _is(x, "OBJECT")), lambda x: one(i, x))
    objects = F.flatten(F.transform("_l", lambda e, i: F.when(_is(e, "OBJECT"), F.array(one(F.lit(None), e))).when(_is(e, "ARRAY"), of(e, i)).otherwise(F.array().cast("array<struct<outer:int,x:variant>>"))))
    return lists.select(*keys, "whole", objects.alias("_o"))


def _element(o: Column) -> tuple[Column, ...]:
    get = lambda path, kind: F.try_variant_get(o["x"], path, kind)
    return (
        F.coalesce(get("$.page_idx", "int"), o["outer"], F.lit(0)).alias("page_idx"), F.coalesce(get("$.type", "string"), F.lit("text")).alias("kind"),
        F.coalesce(get("$.text", "string"), F.lit("")).alias("text"), get("$.bbox", "array<double>").alias("bbox"),
    )


def reply_elements(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """(keys, whole, pos, page_idx, kind, text, bbox) of all elements, with the reply's Markdown; a reply without any has one row
    without pos. A list of lists has a page's elements in each, an element's own page index going first; what isn't an object is no element."""
    rows = _objects(replies, keys, reply).select(*keys, "whole", F.posexplode_outer("_o").alias("pos", "_e"))
    return rows.select(*keys, "whole", "pos", *_element(F.col("_e")))


def reply_pages(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """Pages of each reply; a reply without elements is one page of its Markdown. Replies are read once, and only elements move."""
    return element_pages(reply_elements(replies, keys, reply), keys, "whole")
