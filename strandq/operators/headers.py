"""Headers of variant and alignment records as rows: lines taken apart, their fields edited, and one header made of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import skew

#: The field that tells the lines of a kind apart in alignment headers (in variant headers it is ID).
IDENTITY = {"SQ": "SN", "RG": "ID", "PG": "ID"}
#: The kinds of variant headers whose lines say how many values of which type a name has.
TYPED = ("INFO", "FORMAT")
#: A name with a value in quotes, within which a backslash stands before quotes and backslashes, or with one up to the next comma.
_FIELD = r'([A-Za-z0-9_.-]+)=("(?:[^"\\]|\\.)*"|[^,"]*)'


def field(fields: Column, name: str) -> Column:
    """The value of a field, null without it; of several the first."""
    return F.get(F.filter(fields, lambda x: x["name"] == name), F.lit(0))["value"]


def with_field(fields: Column, name: str, value: Column, quoted: bool = False) -> Column:
    """The fields with one set to a value where it stands, put behind the others if it isn't there, or taken out for a null."""
    new = F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(quoted).alias("quoted"))
    there = F.exists(fields, lambda x: x["name"] == name)
    put = F.when(there, F.transform(fields, lambda x: F.when(x["name"] == name, new).otherwise(x))).otherwise(F.concat(fields, F.array(new)))
    return F.when(value.isNull(), F.filter(fields, lambda x: x["name"] != name)).otherwise(put)


def parsed(lines: DataFrame) -> DataFrame:
    """source, nth, mark, kind, id, value, fields of header lines (source, nth, line).

    mark is ## or @.  Lines of the form ##kind=<name=value,...> and @kind<tab>name:value... have fields (an array of name, value,
    quoted, in their order) and maybe an id; ##kind=value and @CO comments have a value.  Other lines, and null ones, give no row."""
    line, at = F.col("line"), F.col("line").startswith("@")
    kind = F.when(at, F.substring(line, 2, 2)).otherwise(F.regexp_extract(line, r"^##([^=]+)=", 1))
    rest = F.when(at, F.substring(line, 5, 1 << 30)).otherwise(F.regexp_replace(line, r"^##[^=]+=", ""))
    rows = lines.filter(line.rlike(r"^##[^=]+=") | line.rlike(r"^@[A-Z][A-Z]\t")).select("source", "nth", F.when(at, "@").otherwise("##").alias("mark"), kind.alias("kind"), rest.alias("rest"))
    one = lambda name, value, quoted: F.struct(name.alias("name"), value.alias("value"), quoted.alias("quoted"))
    plain = lambda v: F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), r"\\(.)", "$1")
    of_angles = F.zip_with(F.regexp_extract_all("rest", F.lit(_FIELD), F.lit(1)), F.regexp_extract_all("rest", F.lit(_FIELD), F.lit(2)), lambda n, v: one(n, F.when(v.startswith('"'), plain(v)).otherwise(F.regexp_replace(v, ">$", "")), v.startswith('"')))
    of_tabs = F.transform(F.split("rest", "\t"), lambda x: one(F.substring(x, 1, 2), F.substring(x, 4, 1 << 30), F.lit(False)))
    fields = F.when((F.col("mark") == "@") & (F.col("kind") != "CO"), of_tabs).when((F.col("mark") == "##") & F.col("rest").rlike("(?s)^<.*>$"), of_angles)
    rows = rows.select("source", "nth", "mark", "kind", "rest", fields.alias("fields"))
    own = F.when(F.col("mark") == "##", field(F.col("fields"), "ID"))
    for k, name in IDENTITY.items():
        own = own.when(F.col("kind") == k, field(F.col("fields"), name))
    return rows.select("source", "nth", "mark", "kind", own.alias("id"), F.when(F.col("fields").isNull(), F.col("rest")).alias("value"), "fields")


def written() -> Column:
    """The line of a row of parsed()."""
    escaped = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))
    angles = F.array_join(F.transform("fields", lambda x: F.concat(x["name"], F.lit("="), F.when(x["quoted"], escaped(x["value"])).otherwise(x["value"]))), ",")
    tabs = F.array_join(F.transform("fields", lambda x: F.concat(x["name"], F.lit(":"), x["value"])), "\t")
    variant = F.concat(F.lit("##"), "kind", F.lit("="), F.when(F.col("fields").isNull(), F.col("value")).otherwise(F.concat(F.lit("<"), angles, F.lit(">"))))
    return F.when(F.col("mark") == "##", variant).otherwise(F.concat(F.lit("@"), "kind", F.lit("\t"), F.when(F.col("fields").isNull(), F.col("value")).otherwise(tabs)))


def merged(rows: DataFrame) -> DataFrame:
    """source, nth, mark, kind, id, value, fields, differs: one header of the rows of parsed() of many.

    Of lines of one kind and id the first stays, in the order of source and nth; differs says whether INFO or FORMAT lines of
    that id have other numbers or types than each other.  Variant lines with a value alone stay if no earlier source has their kind, lines of
    fields without an id if they are in the first source of all; all comments of alignment headers stay.  An id that very
    many lines have is combined before it is shuffled.  Rows are taken apart once, and kept for the passes over them."""
    rows = materialise(rows)
    shape = F.struct(*(F.coalesce(field(F.col("fields"), c), F.lit("")).alias(c) for c in ("Number", "Type")))
    named = rows.filter("id is not null").groupBy("mark", "kind", "id").agg(F.min(F.struct("source", "nth", "value", "fields")).alias("first"), F.min(shape).alias("a"), F.max(shape).alias("b"))
    named = named.select("first.source", "first.nth", "mark", "kind", "id", "first.value", "first.fields", (F.col("kind").isin(*TYPED) & (F.col("a") != F.col("b"))).alias("differs"))
    alone = rows.filter("id is null and fields is null and mark = '##'")
    hot = skew.heavy(alone, ["kind"], alone.count())
    firsts = skew.copied(alone.groupBy("kind").agg(F.min("source").alias("source")), hot, ["kind"])
    values = skew.dealt(alone, hot, ["kind"], "source", "nth").join(firsts, ["kind", "cell", "source"], "left_semi").select(rows.columns)
    least = rows.agg(F.min("source")).first()[0]
    others = rows.filter((F.col("id").isNull() & F.col("fields").isNotNull() & (F.col("source") == F.lit(least))) | (F.col("fields").isNull() & (F.col("mark") == "@")))
    return named.unionByName(values.unionByName(others).withColumn("differs", F.lit(False)))


def with_ids(rows: DataFrame, kind: str, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of other kinds, and those of a kind whose id is among ids (id), or isn't; lines without id count as not among them."""
    wanted = ids.select("id", F.lit(kind).alias("kind")).distinct()
    own = rows.filter(F.col("kind") == kind).join(wanted, ["kind", "id"], "left_semi" if keep else "left_anti").select(rows.columns)
    return rows.filter(F.col("kind") != kind).unionByName(own)
