"""Joins, de-duplication, counting and numbering over catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lokalith.functions import predicates, text


#: Ranges of a group at most.
RANGES = 256


def first_wins(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """One row per key: the first by ``order``. A partial aggregate, so hot keys shrink before the shuffle."""
    return _pick(df, keys, F.min_by, order)


def last_wins(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys: tuple[str, ...], by: Callable, order: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(by(F.struct(*others), F.col(order)).alias("r")).select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def _same_source() -> Column:
    """Aggregate: all sources of the group are equal. Digests stand for the texts, so no text is compared twice or shuffled for it."""
    return F.min(F.md5("source")) == F.max(F.md5("source"))


def conflicting_keys(df: DataFrame) -> DataFrame:
    """``src_path, key`` with more than one source within a file."""
    return df.groupBy("src_path", "key").agg((~_same_source()).alias("bad")).where("bad").select("src_path", "key")


def without_conflicts(df: DataFrame) -> DataFrame:
    return df.join(conflicting_keys(df), ["src_path", "key"], "left_anti").select(*df.columns)


def conflict_report(df: DataFrame) -> DataFrame:
    """All rows of conflicting keys; :func:`by_key` orders them for people."""
    return df.join(conflicting_keys(df), ["src_path", "key"], "left_semi").select(*df.columns)


def by_key(report: DataFrame) -> DataFrame:
    return report.orderBy("key", "src_path", "ord")


def merge(new: DataFrame, old: DataFrame) -> DataFrame:
    """Full outer merge on ``key``: an earlier translation wins, else the earlier source where the text changed.

    ``old`` has one row per key (see :func:`collapse_old`); rows only there are appended as they are.
    """
    o = old.select(F.col("key").alias("o_key"), F.col("source").alias("o_source"), F.coalesce("translation", F.lit("")).alias("o_translation"))
    joined = new.select("key", "source", "translation").join(o, F.col("key") == F.col("o_key"), "full_outer")
    translation = (
        F.when(F.col("key").isNull() | (F.col("o_translation") != ""), F.col("o_translation"))
        .when(F.col("o_key").isNotNull() & (F.col("source") != text.escape(F.col("o_source"))), F.col("o_source"))
        .otherwise(F.col("translation"))
    )
    state = F.when(F.col("o_key").isNull(), "new").when(F.col("key").isNull(), "added").otherwise("merged")
    return joined.select(F.coalesce("key", "o_key").alias("key"), F.coalesce("source", "o_source").alias("source"), translation.alias("translation"), state.alias("state"))


def collapse_old(old: DataFrame, order: str = "ord") -> DataFrame:
    """Repeated keys of an earlier catalog: the first source, the last translation that is not empty."""
    filled = F.when(F.coalesce("translation", F.lit("")) != "", F.col(order))
    return old.groupBy("key").agg(F.min_by("source", order).alias("source"), F.coalesce(F.max_by("translation", filled), F.lit("")).alias("translation"))


def merge_counters(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("state") != "added").alias("extracted"), F.count_if(F.col("state") == "merged").alias("merged"),
        F.count_if(F.col("state") == "added").alias("added"), F.count(F.lit(1)).alias("total")
    )


def sidecar_join(rows: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Stored hashes by key, one leading ``namespace::`` ignored; ``sidecar(hash_key, ns_hash, key_hash)``."""
    key = text.composite_key(F.col("namespace"), text.without_one_prefix(F.col("namespace"), F.col("key")))
    return rows.drop("ns_hash", "key_hash").withColumn("hash_key", key).join(sidecar, "hash_key", "left").drop("hash_key").fillna(0, ["ns_hash", "key_hash"])


def union_missing(assets: DataFrame, more: DataFrame) -> DataFrame:
    """``assets`` and the first row of each further key in ``more`` with a source that is not blank."""
    fresh = first_wins(more.where(~predicates.is_blank(F.col("source"))), "key").join(assets.select("key"), "key", "left_anti")
    return assets.unionByName(fresh.select(*assets.columns))


def other_key_semi(left: DataFrame, right: DataFrame, group: str = "src_path", strict_anti: bool = False) -> DataFrame:
    """Rows of ``left`` where ``right`` has, in the group, a different key (or no row at all).

    The inequality join collapses to two numbers a group: number of keys and the smallest. ``strict_anti`` is the plain
    anti join on the key.
    """
    if strict_anti:
        return left.join(right.select(group, "key"), [group, "key"], "left_anti")
    few = right.groupBy(group).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return left.join(few, group, "left").where("lo is null or lo <> hi or lo <> key").select(*left.columns)


def backfill(rows: DataFrame, journal: DataFrame) -> DataFrame:
    """Blank translations from a journal of (source, translation)."""
    j = journal.select("source", F.col("translation").alias("j"))
    blank = predicates.is_blank(F.col("translation"))
    return rows.join(j, "source", "left").withColumn("translation", F.when(blank, F.coalesce("j", "translation")).otherwise(F.col("translation"))).select(*rows.columns)


def apply_translations(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Every row of a translated source takes the translation, also one that had another."""
    d = done.select("source", F.col("translation").alias("d"))
    return rows.join(d, "source", "left").withColumn("translation", F.coalesce("d", "translation")).select(*rows.columns)


def unique_sources(rows: DataFrame, order: str = "ord") -> DataFrame:
    return first_wins(rows, "source", order=order)


def running(df: DataFrame, group: str, order: str = "ord", amount: Column | None = None, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``index`` (0-based within the group, in order) and, given ``amount``, ``before`` (its running sum, exclusive).

    Groups of more than ``width`` rows are cut at quantiles of ``order``, about one for each ``width`` of their rows (RANGES at
    most, so a group of more than RANGES * ``width`` rows has longer ranges), however the values lie. Ranges are numbered each by itself and shifted by
    the sums of the ranges before. Rows with equal ``order`` are in one range. Cuts are approximate, numbers exact.
    """
    small = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx(order, F.lit([k / RANGES for k in range(1, RANGES)]), F.lit(4 * RANGES)).alias("_cuts"))
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGES) * width / F.col("_rows"))).cast("int")  # every so many cuts are enough
    large = small.where(F.col("_rows") > width).withColumn("_step", step)
    large = large.select("_g", F.array_distinct(F.filter("_cuts", lambda x, k: (k + 1) % F.col("_step") == 0)).alias("_cuts"))
    ranged = F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col(order))), F.lit(0))
    cut = df.join(large, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(ranged)).drop("_g", "_cuts")
    cut = cut.withColumn("_amount", F.lit(0) if amount is None else amount)
    inside = Window.partitionBy(group, "_range").orderBy(order)
    own = cut.withColumn("_n", F.row_number().over(inside) - 1).withColumn("_sum", F.coalesce(F.sum("_amount").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = cut.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranges.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_total")
    )
    joined = own.join(shift, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    added = [(F.col("_n") + F.col("_rows")).alias("index"), *([(F.col("_sum") + F.col("_total")).alias("before")] if amount is not None else [])]
    return joined.select(*df.columns, *added)


def open_rows(rows: DataFrame) -> DataFrame:
    """Rows that wait for a translation."""
    return rows.where(~predicates.is_blank(F.col("source")) & predicates.is_blank(F.col("translation")))


def translation_batches(rows: DataFrame, size: int = 150, group: str = "src_path") -> DataFrame:
    """``group, batch, n, payload``: untranslated sources in order, joined by ``|||`` for one request each."""
    waiting = open_rows(rows).select(group, "ord", F.replace("source", F.lit("|||"), F.lit("")).alias("s"))
    numbered = running(waiting, group).withColumn("batch", F.floor(F.col("index") / size))
    parts = F.array_sort(F.collect_list(F.struct("ord", "s")))
    return numbered.groupBy(group, "batch").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda x: x["s"]), "|||").alias("payload"))


def split_segments(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(F.split(column, r"\|\|\|")).alias("segment", "t")).withColumn("t", F.trim("t"))


def accepted_batches(batches: DataFrame, reply: Callable[[Column], Column]) -> DataFrame:
    """Replies whose number of segments equals the batch; others are skipped. ``reply`` stands for the translator."""
    answered = batches.withColumn("answer", reply(F.col("payload")))
    return answered.where(F.size(F.split("answer", r"\|\|\|")) == F.col("n"))


def namespace_order(rows: DataFrame) -> DataFrame:
    """``namespace, ns_index``: order of first appearance. One row per namespace reaches the window."""
    firsts = rows.groupBy("namespace").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
    return firsts.select("namespace", (F.row_number().over(Window.orderBy("first")) - 1).alias("ns_index"), "n")


def layout(rows: DataFrame, group: str = "src_path") -> DataFrame:
    """Byte offsets and string numbers of the entries of each file: running sums in the file's order."""
    sized = rows.select(group, "ord", (text.fstring_size(F.col("key")) + 8).alias("size"))
    return running(sized, group, amount=F.col("size")).select(group, "ord", F.col("index").alias("str_idx"), F.col("before").alias("offset"), "size")


def disambiguated_names(paths: DataFrame, path: str = "path", container: str = "container") -> DataFrame:
    """Base names; where any repeats (ignoring case), all get ``_<container>``."""
    named = paths.withColumn("base", text.base_name(F.col(path)))
    repeats = named.groupBy(F.lower("base")).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    return named.crossJoin(F.broadcast(repeats)).select(
        path, container, F.when(F.col("most") > 1, F.concat("base", F.lit("_"), container)).otherwise(F.col("base")).alias("csv_base_name"),
    )


def verify_counters(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("namespace").alias("namespaces"), F.count(F.lit(1)).alias("entries"), F.count_if(F.col("source") != "").alias("filled"))


def entropy(df: DataFrame, key: str, column: str) -> DataFrame:
    """Shannon entropy of each text's characters: exploded, pre-aggregated map-side."""
    chars = df.select(key, F.explode(F.split(column, "")).alias("c")).groupBy(key, "c").agg(F.count(F.lit(1)).alias("n"))
    total = chars.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(key, F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


def csv_lines(rows: DataFrame, separator: str = ",", plain_translation: bool = False) -> DataFrame:
    """Rendered lines with their sort column (what precedes the first ``::``, else the line).

    ``plain_translation`` wraps every source in quotes and leaves source and translation unescaped.
    """
    key, source, translation = (F.coalesce(F.col(x), F.lit("")) for x in ("key", "source", "translation"))
    rest = [F.concat(F.lit('"'), source, F.lit('"')), translation] if plain_translation else [text.csv_field(source), text.csv_field(translation)]
    line = F.concat_ws(separator, text.csv_field(key), *rest)
    return rows.select(line.alias("line")).withColumn("sort_key", F.when(F.instr("line", "::") > 0, F.substring_index("line", "::", 1)).otherwise(F.col("line")))


def in_csv_order(lines: DataFrame, *before: str, collation: str | None = None) -> DataFrame:
    """Lines by sort column, then line; binary order, or that of a collation such as ``UNICODE``."""
    by = [F.col(x) if collation is None else F.collate(F.col(x), collation) for x in ("sort_key", "line")]
    return lines.orderBy(*before, *by, *([] if collation is None else ["line"]))


def last_rows(rows: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Without conflicting keys and developer namespaces, the last writer of each key: that with the greatest ``(src_path, ord)``.

    One aggregate a file and key finds conflicts and the last row at once, a second one the last file. Rows that are not
    ``wanted`` count for conflicts but are not written.
    """
    others = [c for c in rows.columns if c not in ("src_path", "key")]
    written = ~predicates.is_developer_namespace(F.col("namespace")) & (F.lit(True) if wanted is None else wanted)
    row = F.when(written, F.struct(*others))
    per_file = rows.groupBy("src_path", "key").agg(_same_source().alias("_same"), F.max_by(row, F.when(written, F.col("ord"))).alias("_r"))
    kept = per_file.where(F.col("_same") & F.col("_r").isNotNull())
    last = kept.groupBy("key").agg(F.max_by(F.struct("src_path", "_r"), F.struct("src_path", "_r.ord")).alias("_f"))
    return last.select(*[F.col(c) if c == "key" else F.col("_f.src_path") if c == "src_path" else F.col(f"_f._r.{c}").alias(c) for c in rows.columns])


def extract(rows: DataFrame) -> DataFrame:
    """The flagship chain: conflicts out, developer namespaces out, the last writer of each key, noise out.

    Noise goes last, so a placeholder beside a text is a conflict; the costly predicates see what is left.
    """
    return last_rows(rows).where(~predicates.is_not_allowed(F.col("source")))


def distinct_ignoring_case(df: DataFrame, column: str, order: str = "ord") -> DataFrame:
    """Of rows whose ``column`` differs in case only, the first by ``order``."""
    return first_wins(df.withColumn("_low", F.lower(column)), "_low", order=order).drop("_low")


def first_extensions(paths: DataFrame, path: str = "path", order: str = "ord", n: int = 20) -> DataFrame:
    """``extension``: the first ``n`` different extensions in order of appearance."""
    seen = paths.select(F.regexp_extract(path, r"\.[^./\\]*\z", 0).alias("extension"), order).where("length(extension) > 1")
    return seen.groupBy("extension").agg(F.min(order).alias("first")).orderBy("first", "extension").limit(n).select("extension")


def patch_counters(strings: DataFrame) -> DataFrame:
    """``translated, kept, total`` of patched strings; strings without a key are neither translated nor kept."""
    return strings.agg(F.count_if("translated").alias("translated"), F.count_if(~F.col("translated") & F.col("key").isNotNull()).alias("kept"), F.count(F.lit(1)).alias("total"))


def process_counters(decoded: DataFrame, path: str = "path", error: str = "error") -> DataFrame:
    """``processed, errors``: files read, and files that gave an error."""
    files = decoded.groupBy(path).agg(F.max(F.col(error).isNotNull()).alias("bad"))
    return files.agg(F.count(F.lit(1)).alias("processed"), F.count_if("bad").alias("errors"))


def candidates(scored: DataFrame, least: float, denied: DataFrame, key: str = "key", score: str = "entropy") -> DataFrame:
    """Rows of at least ``least`` whose key, in upper case, is not among ``denied(key)``."""
    names = denied.select(F.upper("key").alias("_denied")).distinct()
    return scored.where(F.col(score) >= least).join(names, F.upper(F.col(key)) == F.col("_denied"), "left_anti")


def top(scored: DataFrame, n: int = 1, key: str = "key", score: str = "entropy") -> DataFrame:
    """The ``n`` best, equal scores by key. A top-k report: the limit is the feature."""
    return scored.orderBy(F.desc(score), key).limit(n)


def first_matching(df: DataFrame, condition: Column, order: str = "ord") -> DataFrame:
    """The first row by ``order`` that meets the condition, none where none does."""
    return df.where(condition).groupBy().agg(F.min_by(F.struct(*df.columns), order).alias("r")).where("r is not null").select("r.*")


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a stated order, for reports."""
    return df.orderBy(*order).limit(n)


def text_search(rows: DataFrame, part: str) -> DataFrame:
    """``src_path, key, source`` of the rows whose source holds ``part``."""
    return rows.where(F.contains("source", F.lit(part))).select("src_path", "key", "source")


def with_title(games: DataFrame, titles: DataFrame, name: str = "folder", program: bool = False) -> DataFrame:
    """``games`` with ``title`` from ``titles(name, title)``, names compared without case, dashes and underscores.

    The titles are those that the caller or :data:`lokalith.plans.games.TITLES` gives.
    """
    known = titles.groupBy(F.lower("name").alias("_name")).agg(F.max("title").alias("title"))
    return games.withColumn("_key", text.title_key(F.col(name), program)).join(known, F.col("_key") == F.col("_name"), "left").drop("_key", "_name")


def engine_version(explicit: Column, program_version: Column, title: Column, known: Column, oldest: str = "UE4_LATEST", newest: str = "UE5_LATEST") -> Column:
    """An explicit version, else the title's profile, else the program's version, else the newest.

    ``known`` holds the versions that exist: one that is stated but unknown counts as ``oldest``.
    """
    checked = lambda c: F.when(F.array_contains(known, c), c).otherwise(oldest)
    given = F.coalesce(explicit, F.lit("")) != ""
    return F.when(given, checked(text.version_name(explicit))).otherwise(F.coalesce(title, F.when(program_version.isNotNull(), checked(program_version)), F.lit(newest)))
