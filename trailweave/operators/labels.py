"""Category price labels, imputation of price, rating and rating counts, and label evaluation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Category ids forced to free or paid, and the name fragments that decide otherwise.
FREE_IDS = [
    "12094", "12064", "12000", "11045", "11128", "11001", "12047", "12009", "12080", "12013", "12014", "12031", "12022", "12021",
    "12048", "12058", "12017", "12101", "12106", "12108", "12099", "16032", "16041", "16020", "16026", "16017", "16046", "16001",
    "16006", "16007", "16030", "12075", "16003", "15014", "10047", "12003", "19042", "19046", "19050", "19022", "19047", "12086",
]
PAID_IDS = [
    "13065", "13034", "13003", "13020", "13035", "13099", "13272", "13026", "17029", "13145", "17043", "10032", "17035", "13064",
    "13006", "10021", "17018", "17048", "19014", "17036",
]
FREE_FRAGMENTS = ("park", "plaza", "church", "mosque", "library", "garden", "cemetery")
PAID_FRAGMENTS = ("restaurant", "shop", "store", "hotel")


def forced_name_sets(cats: DataFrame, free_ids=FREE_IDS, paid_ids=PAID_IDS) -> DataFrame:
    """(name, forced): names of categories whose id is in a forced list; a name may be in both."""
    cid = F.col("category_id")
    forced = F.array_compact(F.array(F.when(cid.isin(*free_ids), "free"), F.when(cid.isin(*paid_ids), "paid")))
    rows = cats.where("category_id <> '' AND category_name <> ''").select(F.col("category_name").alias("name"), F.explode(forced).alias("forced"))
    return rows.distinct()


def _has_any(c: Column, fragments) -> Column:
    out = F.lit(False)
    for f in fragments:
        out = out | F.contains(c, F.lit(f))
    return out


def force_labels(labels: DataFrame, forced: DataFrame) -> DataFrame:
    """Labels with free/paid forced by name or name fragment, and forced names that had no label."""
    flags = forced.groupBy("name").agg(F.bool_or(F.col("forced") == "free").alias("_free"), F.bool_or(F.col("forced") == "paid").alias("_paid"))
    trimmed = F.trim(F.coalesce("name", F.lit("")))
    rows = labels.withColumn("_name", trimmed).join(flags.withColumnRenamed("name", "_name"), "_name", "left")
    lowered = F.lower("_name")
    free = F.coalesce("_free", F.lit(False)) | _has_any(lowered, FREE_FRAGMENTS)
    paid = ~free & (F.coalesce("_paid", F.lit(False)) | _has_any(lowered, PAID_FRAGMENTS))
    updated = rows.select(
        "label_id", "name",
        F.when(free, F.lit(True)).when(paid, F.lit(False)).otherwise(F.col("free")).alias("free"),
        F.when(free, F.lit(0)).when(paid, F.coalesce("price_tier", F.lit(2))).otherwise(F.col("price_tier")).alias("price_tier"),
        F.when(free, F.coalesce("source", F.lit("force_name_free"))).when(paid, F.coalesce("source", F.lit("force_name_paid"))).otherwise(F.col("source")).alias("source"),
    )
    absent = forced.join(labels.select("name").where("name IS NOT NULL").distinct(), "name", "left_anti")
    is_free = F.col("forced") == "free"
    added = absent.select(
        F.concat(F.lit("name_"), "forced", F.lit("::"), "name").alias("label_id"), "name", is_free.alias("free"),
        F.when(is_free, 0).otherwise(2).alias("price_tier"), F.concat(F.lit("force_name_"), "forced").alias("source"))
    return updated.unionByName(added)


def category_medians(cats: DataFrame, pois: DataFrame) -> DataFrame:
    """(category_id, med_price, med_rating, med_total): medians over the POIs carrying a category.

    Values are counted per category first, so the median sees one weighted row per distinct value.
    """
    values = F.array(
        F.struct(F.lit("price").alias("what"), F.when(F.col("price_tier").between(0, 4), F.col("price_tier").cast("double")).alias("v")),
        F.struct(F.lit("rating").alias("what"), F.col("rating").cast("double").alias("v")),
        F.struct(F.lit("total").alias("what"), F.col("total_ratings").cast("double").alias("v")))
    rows = cats.where("category_id <> ''").join(pois.select("poi_id", F.explode(values).alias("x")), "poi_id")
    counted = rows.where("x.v IS NOT NULL").groupBy("category_id", "x.what", "x.v").agg(F.count("*").alias("n"))
    med = F.expr("percentile(v, 0.5, n)")
    out = counted.groupBy("category_id", "what").agg(med.alias("m"))
    pick = lambda w: F.max(F.when(F.col("what") == w, F.col("m")))
    return out.groupBy("category_id").agg(pick("price").alias("med_price"), pick("rating").alias("med_rating"), pick("total").alias("med_total"))


def impute_price(pois: DataFrame, cats: DataFrame, labels: DataFrame, medians: DataFrame) -> DataFrame:
    """(poi_id, price_tier, is_free).

    By category order: a free label by id gives tier 0; else the first tier by id; else by
    name; else the rounded category median; else the price stays as it is.
    """
    by_id = labels.select(F.col("label_id").alias("category_id"), F.col("free").alias("id_free"), F.col("price_tier").alias("id_tier"))
    # labels of one name in their own order: a free one wins, else the first tier
    by_name = labels.where("trim(name) <> ''").groupBy(F.lower(F.trim("name")).alias("_lname")).agg(
        F.bool_or("free").alias("name_free"), F.min_by("price_tier", F.when(F.col("price_tier").isNotNull(), F.col("label_id"))).alias("name_tier"))
    rows = (
        cats.withColumn("_lname", F.lower(F.trim("category_name")))
        .join(by_id, "category_id", "left").join(by_name, "_lname", "left")
        .join(medians.select("category_id", "med_price"), "category_id", "left")
    )
    has_tier = F.col("id_tier").isNotNull()
    name_hit = F.col("name_free") | F.col("name_tier").isNotNull()
    per_poi = rows.groupBy("poi_id").agg(
        F.coalesce(F.bool_or("id_free"), F.lit(False)).alias("id_free"),
        F.min_by("id_tier", F.when(has_tier, F.col("ord"))).alias("id_tier"),
        F.min_by(F.struct(F.coalesce("name_free", F.lit(False)).alias("free"), F.col("name_tier").alias("tier")), F.when(name_hit, F.col("ord"))).alias("nm"),
        F.min_by("med_price", F.when(F.col("med_price").isNotNull(), F.col("ord"))).alias("med"),
    )
    joined = pois.select("poi_id", "price_tier").join(per_poi, "poi_id", "left")
    name_free = F.coalesce(F.col("nm.free"), F.lit(False))
    free = F.coalesce("id_free", F.lit(False)) | (F.col("id_tier").isNull() & name_free)
    tier = F.when(free, F.lit(0)).otherwise(F.coalesce("id_tier", "nm.tier", F.bround("med").cast("int")))
    return joined.select(
        "poi_id", F.coalesce(tier, F.col("price_tier")).cast("int").alias("price_tier"),
        (free | F.coalesce(tier == 0, F.lit(False))).alias("is_free"))


def impute_rating_counts(pois: DataFrame, cats: DataFrame, medians: DataFrame) -> DataFrame:
    """(poi_id, rating, total_ratings): missing values from the first category having a median."""
    rows = cats.join(medians, "category_id").groupBy("poi_id").agg(
        F.min_by("med_rating", F.when(F.col("med_rating").isNotNull(), F.col("ord"))).alias("mr"),
        F.min_by("med_total", F.when(F.col("med_total").isNotNull(), F.col("ord"))).alias("mt"))
    return pois.join(rows, "poi_id", "left").select(
        "poi_id", F.coalesce("rating", "mr").alias("rating"),
        F.coalesce(F.bround(F.col("total_ratings").cast("double")), F.bround("mt"), F.lit(0)).cast("long").alias("total_ratings"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _confusion(truth: Column, pred: Column) -> list[Column]:
    return [
        F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"),
        F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn")]


def _with_prf(df: DataFrame) -> DataFrame:
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def label_eval(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of free/paid quality against (label_id, gt_free, gt_tier); unlabelled truth is skipped."""
    rows = truth.join(labels, "label_id", "left")
    pred = F.coalesce("free", F.lit(False))
    known = F.col("name").isNotNull()
    tiered = known & F.col("gt_tier").isNotNull() & ~pred & F.col("price_tier").isNotNull()
    out = rows.agg(
        F.count("*").alias("n_truth"),
        *[F.count_if(known & t & p).alias(n) for n, t, p in (
            ("tp", F.col("gt_free"), pred), ("fp", ~F.col("gt_free"), pred), ("fn", F.col("gt_free"), ~pred), ("tn", ~F.col("gt_free"), ~pred))],
        F.count_if(tiered).alias("n_tier"), F.count_if(tiered & (F.col("price_tier") == F.col("gt_tier"))).alias("tier_ok"))
    return _with_prf(out).withColumn("tier_accuracy", _ratio(F.col("tier_ok"), F.col("n_tier")))


def label_crosscheck(labels: DataFrame, cats: DataFrame, pois: DataFrame, excluded_ids) -> DataFrame:
    """Labels against the median observed price per category, forced ids left out."""
    observed = category_medians(cats, pois).where("med_price IS NOT NULL").select(F.col("category_id").alias("label_id"), "med_price")
    rows = labels.where(~F.col("label_id").isin(*excluded_ids)).join(observed, "label_id")
    gt = F.col("med_price") == 0
    both_paid = ~gt & ~F.col("free") & F.col("price_tier").isNotNull()
    gt_tier = F.bround("med_price").cast("int")
    out = rows.agg(
        F.count("*").alias("n_tested"), *_confusion(gt, F.col("free")),
        F.count_if(both_paid).alias("n_tier"), F.count_if(both_paid & (F.col("price_tier") == gt_tier)).alias("tier_ok"),
        F.coalesce(F.sum(F.when(both_paid, F.abs(F.col("price_tier") - gt_tier))), F.lit(0)).cast("long").alias("diff"))
    return _with_prf(out).withColumns({
        "tier_accuracy": _ratio(F.col("tier_ok"), F.col("n_tier")), "mae": _ratio(F.col("diff"), F.col("n_tier"))}).drop("diff")


