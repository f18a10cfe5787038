"""Records on their way out: actions, names of files, ledgers, paths, keys, casts by schema."""

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_actions(records: DataFrame, target: DataFrame, key: list[str], policy: str = "skip") -> DataFrame:
    """records (key, profile) with action and target_id: create where no row of the target (key, id, profile) matches, or policy is copy; else skip, or under
    overwrite update the only match or the only one of the record's profile; ambiguous where it can't be told which."""
    if policy not in ("skip", "overwrite", "copy"):
        raise ValueError("policy must be skip, overwrite or copy")
    matches = target.groupBy(*key).agg(F.count("*").alias("_n"), F.max("id").alias("_one"))
    own = target.groupBy(*key, "profile").agg(F.count("*").alias("_own"), F.max("id").alias("_mine"))
    x = records.join(matches, key, "left").join(own, [*key, "profile"], "left")
    which = F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_own") == 1, F.col("_mine"))
    found = F.col("_n").isNotNull()
    if policy == "copy":
        action, at = F.lit("create"), F.lit(None).cast("long")
    elif policy == "skip":
        action, at = F.when(found, "skip").otherwise("create"), F.lit(None).cast("long")
    else:
        action, at = F.when(~found, "create").when(which.isNotNull(), "update").otherwise("ambiguous"), which
    return x.withColumn("action", action).withColumn("target_id", at).drop("_n", "_one", "_own", "_mine")


def items_to_replace(items: DataFrame, found: DataFrame) -> DataFrame:
    """The items (record, profile, collection) that an update may delete: made by this profile from a collection that the record has now (found: record, profile, collection)."""
    return items.join(found.select("record", "profile", "collection").distinct(), ["record", "profile", "collection"], "left_semi")


def base_name(name: Column) -> Column:
    """A name as files may have it: marks of Latin letters dropped, other than letters, marks, digits, - and _ as one _, 60 characters at most; image if nothing is left."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out: list[str] = []
        latin = False
        for c in unicodedata.normalize("NFKD", text):
            if unicodedata.category(c)[0] == "M":
                if not latin:
                    out.append(c)
                continue
            latin = "LATIN" in unicodedata.name(c, "")
            out.append({"ł": "l", "Ł": "L"}.get(c, c))
        kept = [c if c in "_-" or unicodedata.category(c)[0] in "LMN" else "_" for c in unicodedata.normalize("NFC", "".join(out))]
        short = re.sub("_+", "_", "".join(kept)).removeprefix("_").removesuffix("_")[:60].removesuffix("_")
        return short or "image"

    return F.pandas_udf(lambda s: s.map(one), "string")(name)


def unique_names(files: DataFrame, base: str, extension: str, order: list[str]) -> DataFrame:
    """files with name: base.ext for the first of a base , base-1.ext for the next, and so on, in the order given."""
    w = Window.partitionBy(base, extension).orderBy(*order)
    k = F.row_number().over(w) - 1
    return files.withColumn("_k", k).withColumn("name", F.concat(F.col(base), F.when(F.col("_k") > 0, F.concat(F.lit("-"), F.col("_k").cast("string"))).otherwise(""), F.lit("."), F.col(extension))).drop("_k")


def not_done(work: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """The rows of work whose key the ledger doesn't have: what a retry still has to do."""
    return work.join(ledger.select(*key).distinct(), key, "left_anti")


UNSAFE = {"__proto__", "constructor", "prototype"}


def set_paths(values: Column) -> Column:
    """A map of dotted paths to texts as a nested JSON document; a later path goes through what isn't an object; unsafe names are left out."""

    def one(pairs) -> str | None:
        if pairs is None:
            return None
        out: dict = {}
        for path, value in dict(pairs).items():
            names = path.split(".")
            if UNSAFE & set(names):
                continue
            at = out
            for n in names[:-1]:
                if not isinstance(at.get(n), dict):
                    at[n] = {}
                at = at[n]
            at[names[-1]] = value
        return json.dumps(out, separators=(",", ":"), ensure_ascii=False)

    return F.pandas_udf(lambda s: s.map(one), "string")(values)


def get_path(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON document; null where a step is missing, or unsafe."""
    if UNSAFE & set(path.split(".")):
        return F.lit(None).cast("string")
    return F.get_json_object(document, "$." + ".".join(f"{n}" for n in path.split(".")))


def content_hash(width: Column, height: Column, pixels: Column) -> Column:
    """SHA-256 of width and height, four bytes each, highest first, and the pixels."""
    four = lambda v: F.unhex(F.lpad(F.hex(v.cast("long")), 8, "0"))
    return F.sha2(F.concat(four(width), four(height), pixels), 256)


def mean_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def text_hash(text: Column) -> Column:
    """53 bits of a text's UTF-16 units, in hex: two 32-bit lanes, multiplied unit by unit and mixed at the end."""
    low = 0xFFFFFFFF

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        a, b = 0xDEADBEEF, 0x41C6CE57
        raw = t.encode("utf-16-le", "surrogatepass")
        for k in range(0, len(raw), 2):
            unit = raw[k] | raw[k + 1] << 8
            a, b = (a ^ unit) * 2654435761 & low, (b ^ unit) * 1597334677 & low
        a = ((a ^ a >> 16) * 2246822507 ^ (b ^ b >> 13) * 3266489909) & low
        b = ((b ^ b >> 16) * 2246822507 ^ (a ^ a >> 13) * 3266489909) & low
        return f"{(b & 0x1FFFFF) << 32 | a:x}"

    return F.pandas_udf(lambda s: s.map(one), "string")(text)


def schema_fingerprint(fields: DataFrame, schema: list[str]) -> DataFrame:
    """The schema's columns and fingerprint: the hash of its fields' lines (path, type, integer, least, most, choices), sorted."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws("|", "path", "type", F.when(F.col("integer"), "i").otherwise(""), number("least"), number("most"), F.coalesce(F.array_join("choices", ","), F.lit("")))
    joined = fields.groupBy(*schema).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_l"))
    return joined.select(*schema, text_hash(F.col("_l")).alias("fingerprint"))


def progress(stage: Column, done: Column, total: Column, stages: int) -> Column:
    """Whole percent of all stages."""
    share = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total))).otherwise(0.0)
    return F.floor((stage + share) / stages * 100)


def reports(steps: DataFrame, run: list[str], order: str, percent: str) -> DataFrame:
    """The steps whose percent is above all before them in their run."""
    before = F.max(percent).over(Window.partitionBy(*run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("_b", before).where(F.coalesce(F.col(percent) > F.col("_b"), F.lit(True))).drop("_b")


def complete_pairs(records: DataFrame, base: str) -> DataFrame:
    """records with <base>_value and <base>_max filled from each other where one is null."""
    value, most = f"{base}_value", f"{base}_max"
    return records.withColumns({value: F.coalesce(value, most), most: F.coalesce(most, value)})


def importable(records: DataFrame, diagnostics: DataFrame, key: str) -> DataFrame:
    """records with problems (codes, sorted) and importable: none of their diagnostics (key, severity, code) is an error."""
    d = diagnostics.groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("problems"), F.count_if(F.col("severity") == "error").alias("_e"))
    return records.join(d, key, "left").withColumn("importable", F.coalesce("_e", F.lit(0)) == 0).withColumn("problems", F.coalesce("problems", F.array().cast("array<string>"))).drop("_e")


def valid_profiles(texts: DataFrame, column: str, required: list[str]) -> DataFrame:
    """texts with valid and problem: JSON documents that have the required names; those that aren't go to the caller's reject table by `valid`."""

    def one(text: str | None) -> str | None:
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            return "not-json"
        if not isinstance(doc, dict):
            return "not-an-object"
        missing = [n for n in required if n not in doc]
        return "missing " + ",".join(missing) if missing else None

    problem = F.pandas_udf(lambda s: s.map(one), "string")(F.col(column))
    return texts.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull())


def with_template(fields: DataFrame, template: DataFrame, key: str) -> DataFrame:
    """fields (key, path, value) and, of the template's (path, value), those that a record doesn't map."""
    records = fields.select(key).distinct()
    table = template.select(F.array_agg(F.struct("path", F.col("value").alias("_t"))).alias("_all"))  # one row: a schema's paths
    every = records.crossJoin(F.broadcast(table)).select(key, F.inline("_all"))
    return every.join(fields, [key, "path"], "full").select(key, "path", F.coalesce("value", "_t").alias("value"))
