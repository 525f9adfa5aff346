"""Registry: every analysis over the tables derived from a star-schema folder."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, ShortType, StructType

from storelens.models import clusters, curves, risk
from storelens.models import features as feats
from storelens.operators import audit, customers, descriptive, diagnostic, kpi, mart
from storelens.plans import views
from storelens.session import configure, materialize, store_of
from storelens.sources.files import Tables, append_rows, coercion_report, rejected_rows
from storelens.sources.schemas import SCHEMAS
from storelens.sources.star import STAR_CUTOFF, STAR_TRANSLATION_FIXES, commerce_tables

Query = Callable[[SparkSession, str], DataFrame]

def plain_types(df: DataFrame) -> DataFrame:
    """Report types: decimals as double, all integers as bigint."""
    casts = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, DecimalType):
            casts[field.name] = F.col(f"`{field.name}`").cast("double")
        elif isinstance(field.dataType, (IntegerType, ShortType)):
            casts[field.name] = F.col(f"`{field.name}`").cast("long")
    return df.withColumns(casts) if casts else df


@lru_cache(maxsize=8)
def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables of a folder; only the lazy plans are kept."""
    return commerce_tables(configure(spark), sf_dir)


def _on_tables(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain_types(build(tables(spark, sf_dir)))


def _mart_for(function, t: Tables, cutoff: str | None = STAR_CUTOFF) -> DataFrame:
    return mart.order_mart(t, cutoff, function.columns)


def _on_mart(function, cutoff: str | None = STAR_CUTOFF, **options) -> Query:
    return _on_tables(lambda t: function(_mart_for(function, t, cutoff), **options))


def _on_table(function, name: str, **options) -> Query:
    return _on_tables(lambda t: function(t[name], **options))


def _on_clv(function, **options) -> Query:
    """Analyses that pass over the customer values more than once store them first."""
    return _on_tables(lambda t: function(materialize(customers.clv(_mart_for(customers.clv, t))), **options))


def _rfm(t: Tables) -> DataFrame:
    return customers.rfm_base(_mart_for(customers.rfm_base, t))


def _on_rfm(function, stored: bool = True) -> Query:
    return _on_tables(lambda t: function(materialize(_rfm(t)) if stored else _rfm(t)))


def _segments(rfm: DataFrame) -> DataFrame:
    return customers.rfm_segments(customers.rfm_quantile(rfm))


# --- model queries --------------------------------------------------------------------


def _feature_rows(t: Tables, version: int = 2) -> DataFrame:
    return feats.features(_mart_for(feats.features, t), version)


def _risk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mart rows with all numeric features, reviewed or not, stored once for the split and the scoring."""
    rows = lambda: _mart_for(feats.features, tables(spark, sf_dir)).dropna(subset=list(feats.NUMERIC_V2))
    return store_of(spark).cached(("risk rows", sf_dir), lambda: materialize(rows()))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, stored once per store."""

    def build() -> tuple[DataFrame, DataFrame]:
        split = materialize(feats.stratified_split(feats.features(_risk_rows(spark, sf_dir)), stored=True))
        return split.filter("is_train = 1"), split.filter("is_train = 0")

    return store_of(spark).cached(("split", sf_dir), build)


def _tuned(spark: SparkSession, sf_dir: str) -> tuple[risk.Tuned, risk.Encoding]:
    """The full grid search; run once for the queries that share it."""

    def build() -> tuple[risk.Tuned, risk.Encoding]:
        train, _ = _split(spark, sf_dir)
        encoding = risk.Encoding.learn(train)
        return risk.tune_rf(train, encoding), encoding

    return store_of(spark).cached(("tuned", sf_dir), build)


def _model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models on the test rows; their jobs run side by side."""
    train, test = _split(spark, sf_dir)
    encoding = risk.Encoding.learn(train)
    fits = {
        # The names of the compared models.
        "Logistic Regression (baseline)": lambda: risk.fit_lr(train),
        "Logistic Regression (balanced)": lambda: risk.fit_lr(train, encoding, balanced=True),
        "Random Forest (baseline)": lambda: risk.fit_rf(train, encoding),
        "Random Forest (tuned)": lambda: _tuned(spark, sf_dir)[0].model,
    }

    def judged(name: str) -> DataFrame:
        scored = risk.with_probability(fits[name](), test).select(feats.LABEL, "prediction", "probability_low")
        return risk.evaluate(materialize(scored), name, score="probability_low")

    with ThreadPoolExecutor(len(fits)) as pool:
        # Each thread keeps its tables in the surrounding store.
        return risk.compare([f.result() for f in [pool.submit(copy_context().run, judged, name) for name in fits]])


def _model_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuned(spark, sf_dir)[0].scores


def _feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned, encoding = _tuned(spark, sf_dir)
    return risk.importances(tuned.model, risk.feature_names(encoding), spark)


def _order_risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with complete features are scored, reviewed or not."""
    every = feats.features(_risk_rows(spark, sf_dir), unreviewed="negative")
    return plain_types(risk.score_orders(_tuned(spark, sf_dir)[0].model, every))


def _one_hot_features(t: Tables) -> DataFrame:
    """Labels of the indicators set on each order, in alphabetical order, from the encoder that trains."""
    rows = _feature_rows(t)
    encoding = risk.Encoding.learn(rows)
    encoded = encoding.stage().transform(rows)
    named = sorted((i.label, i.name) for i in encoding.indicators())
    active = F.array(*[F.when(F.col(name) == 1, label) for label, name in named])
    return encoded.select("order_id", F.array_join(F.array_compact(active), ",").alias("active_features"))


def _late_rule(t: Tables) -> DataFrame:
    """A fixed prediction table: a late order is predicted to get a low review."""
    columns = ("is_late", "is_low_review", "delivery_delay_days")
    return mart.order_mart(t, STAR_CUTOFF, columns).dropna(subset=list(columns))


def _rule_metrics(t: Tables) -> DataFrame:
    return risk.evaluate(_late_rule(t), "late rule", prediction="is_late", score="delivery_delay_days")


def _category_grouped(t: Tables) -> DataFrame:
    orders = mart.order_mart(t, STAR_CUTOFF, ["order_id", feats.CATEGORY])
    return mart.group_tail(orders, feats.CATEGORY, 10).select("order_id", "category_grouped")


def _order_ratios(t: Tables) -> DataFrame:
    return mart.order_mart(t, STAR_CUTOFF, ["order_id", "price_per_item", "freight_ratio"])


def _fixed_translation(t: Tables) -> DataFrame:
    return append_rows(t["category_translation"], STAR_TRANSLATION_FIXES)


def _revalidate(t: Tables) -> DataFrame:
    def orphans(translation: DataFrame, stage: str) -> DataFrame:
        found = audit.orphan_values(t["products"], translation, feats.CATEGORY.removesuffix("_english"))
        return found.agg(
            F.lit(stage).alias("stage"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("orphan_products")
        )

    return orphans(t["category_translation"], "before").unionByName(orphans(_fixed_translation(t), "after"))


def _parity(t: Tables) -> DataFrame:
    built = mart.order_mart(t, None)
    counts = audit.rowcount_parity(t["orders"], built, ("orders", "order_mart"))
    paid = mart.primary_payment(t["payments"]).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.unionByName(paid.select(F.lit("order_primary_payment").alias("subject"), "row_count"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their cluster; fitted once for the queries that share it."""

    def build() -> DataFrame:
        return materialize(clusters.kmeans_segments(materialize(_rfm(tables(spark, sf_dir)))))

    return store_of(spark).cached(("clusters", sf_dir), build)


def _kmeans_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_types(clusters.named_segments(_clustered(spark, sf_dir)).drop("cluster", "revenue"))


def _kmeans_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_types(clusters.cluster_profile(_clustered(spark, sf_dir)))


def _rule_clusters(rfm: DataFrame) -> DataFrame:
    """A fixed clustering by rule, in place of a fitted one: how clusters are named can be checked on it."""
    value = F.col("monetary").cast("double")
    cluster = F.when(value > 200_000, 0).when(F.col("frequency") > 1, 1).when(F.col("recency_days") > 1000, 2).otherwise(3)
    return rfm.withColumn("cluster", cluster)


def _sample(rfm: DataFrame) -> DataFrame:
    """5,000 customers with their segment."""
    return clusters.sample_n(_segments(rfm), customers.PERSON, 5000).drop("revenue")


def _fold_counts(t: Tables) -> DataFrame:
    split = feats.stratified_split(_feature_rows(t))
    return split.groupBy(feats.LABEL, "fold").agg(F.count(F.lit(1)).alias("orders"))


def _rule_choice(t: Tables) -> DataFrame:
    """Two fixed rules as models, and the better one by F1."""
    rules = mart.order_mart(t, STAR_CUTOFF, ("is_late", "is_low_review", "delivery_delay_days")).dropna()
    rules = rules.withColumn("very_late", (F.col("delivery_delay_days") > 5).cast("int"))
    rows = [risk.evaluate(rules, "late", prediction="is_late"), risk.evaluate(rules, "very late", prediction="very_late")]
    return risk.choose(risk.compare(rows), ("f1",)).drop("roc_auc")


def _raw_items(t: Tables) -> DataFrame:
    """Order items as text, with bad values seeded by the order's number."""
    text = t["order_items"].select([F.col(c).cast("string").alias(c) for c in t["order_items"].columns])
    order = F.col("order_id").cast("long")

    def seeded(column: str, every: int, value: str) -> Column:
        return F.when(order % every == 0, value).otherwise(F.col(column))

    return text.withColumns({
        "price": seeded("price", 97, "n/a"),
        "freight_value": seeded("freight_value", 101, "1,5"),
        "shipping_limit_date": seeded("shipping_limit_date", 89, "soon"),
        "order_item_id": seeded("order_item_id", 83, " "),
    })


def _coercion_report(t: Tables) -> DataFrame:
    schema = StructType([SCHEMAS["order_items"][c] for c in ("order_item_id", "shipping_limit_date", "price", "freight_value")])
    return coercion_report(_raw_items(t), schema, "order_items")


def _rejected_items(t: Tables) -> DataFrame:
    schema = StructType([SCHEMAS["order_items"][c] for c in ("shipping_limit_date", "price", "freight_value")])
    lost = rejected_rows(_raw_items(t), schema).select("order_id", F.explode("rejects").alias("r"))
    return lost.groupBy(F.col("order_id").cast("long").alias("order_id"), "r.col", "r.value").agg(F.count(F.lit(1)).alias("items"))


QUERIES: dict[str, Query] = {
    # loads
    "coercion_report": _on_tables(_coercion_report),
    "rejected_items": _on_tables(_rejected_items),
    # audit
    "audit_row_counts": _on_tables(audit.row_counts),
    "audit_dup_key": _on_tables(audit.audit_dup_key),
    "audit_dup_composite_key": _on_tables(audit.audit_dup_composite_key),
    "audit_dup_summary": _on_tables(audit.audit_dup_summary),
    "audit_orphans": _on_tables(audit.audit_orphans),
    "audit_orphan_values": _on_tables(audit.audit_orphan_values),
    "audit_null_category": _on_table(audit.null_count, "products", column="product_category_name"),
    "audit_null_profile": _on_tables(audit.audit_null_profile),
    "audit_ranges": _on_tables(audit.audit_ranges),
    "audit_domain": _on_tables(audit.audit_domain),
    "audit_chronology": _on_tables(audit.audit_chronology),
    "audit_date_range": _on_table(audit.date_range, "orders", column="order_purchase_timestamp"),
    "audit_reconcile": _on_tables(audit.audit_reconcile),
    "audit_conflicting_state": _on_table(
        audit.conflicting, "customers", entity="customer_unique_id", attribute="customer_state"
    ),
    "orders_quality_flagged": _on_table(mart.quality_flagged, "orders"),
    "audit_revalidate": _on_tables(_revalidate),
    "audit_parity": _on_tables(_parity),
    "audit_orders_without_items": _on_tables(
        lambda t: audit.childless(t["orders"], t["order_items"], "order_id", "order_status")
    ),
    "audit_multi_child": _on_tables(audit.audit_multi_child),
    "audit_report": _on_tables(views.audit_report),
    "translation_fix": _on_tables(_fixed_translation),
    # marts
    "order_items_agg": _on_table(mart.items_agg, "order_items"),
    "first_item": _on_table(mart.first_item, "order_items"),
    "order_payments_agg": _on_table(mart.pay_agg, "payments"),
    "first_payment_type": _on_table(mart.first_payment, "payments"),
    "primary_payment": _on_table(mart.primary_payment, "payments"),
    "payment_type_list": _on_table(mart.payment_types, "payments"),
    "order_review": _on_table(mart.review_agg, "reviews"),
    "order_mart": _on_tables(lambda t: mart.order_mart(t, STAR_CUTOFF)),
    "orders_enriched": _on_tables(mart.orders_enriched),
    "products_enriched": _on_tables(mart.products_enriched),
    "review_monthly": _on_tables(mart.review_monthly),
    "item_mart": _on_tables(lambda t: mart.item_mart(t, STAR_CUTOFF)),
    "order_ratios": _on_tables(_order_ratios),
    "category_grouped": _on_tables(_category_grouped),
    # KPIs
    "kpi_repeat_rate": _on_mart(kpi.kpi_repeat_rate),
    "kpi_on_time": _on_mart(kpi.kpi_on_time),
    "kri_low_review": _on_mart(kpi.kri_low_review),
    "kpi_aov": _on_mart(kpi.kpi_aov),
    "kpi_aov_all_orders": _on_mart(kpi.kpi_aov, cutoff=None, all_orders=True),
    "kpi_headline": _on_mart(kpi.kpi_headline),
    # descriptive
    "sales_by_status": _on_mart(descriptive.by_status),
    "undelivered_by_status": _on_mart(descriptive.undelivered_by_status),
    "sales_by_state": _on_mart(descriptive.by_state),
    "sales_by_month": _on_mart(descriptive.by_month),
    "peak_month": _on_mart(descriptive.peak_month),
    "orders_by_weekday": _on_mart(descriptive.by_weekday),
    "orders_by_hour": _on_mart(descriptive.by_hour),
    "category_items_top10": _on_tables(descriptive.category_items),
    "category_items_cutoff_top15": _on_tables(partial(descriptive.category_items, k=15, cutoff=STAR_CUTOFF)),
    "category_orders_top10": _on_mart(descriptive.category_orders),
    "review_distribution": _on_mart(descriptive.score_distribution),
    "delivery_summary": _on_mart(descriptive.delivery_summary),
    "delivery_summary_elapsed": _on_tables(
        lambda t: descriptive.delivery_summary(
            mart.order_mart(t, STAR_CUTOFF, descriptive.delivery_summary.columns, delay="floor")
        )
    ),
    "delay_histogram": _on_mart(descriptive.delay_histogram),
    "delay_histogram_full": _on_mart(descriptive.delay_histogram_full),
    "late_rate_by_state": _on_mart(descriptive.late_by_state),
    "payments_by_type": _on_table(descriptive.payments_by_type, "payments"),
    "payment_mix": _on_mart(descriptive.payment_mix),
    "top3_state_share": _on_mart(descriptive.top3_state_share),
    "top3_category_share": _on_mart(descriptive.top3_category_share),
    # diagnostic
    "late_vs_review": _on_mart(diagnostic.late_vs_review),
    "late_review_welch": _on_mart(diagnostic.late_review_welch),
    "weekend_review_welch": _on_mart(diagnostic.weekend_review_welch),
    "late_share_of_low": _on_mart(diagnostic.late_share_of_low),
    "monthly_late_review": _on_mart(diagnostic.monthly_late_review),
    "monthly_late_corr": _on_mart(diagnostic.monthly_late_corr),
    "category_quality": _on_tables(diagnostic.category_quality),
    "category_volume_score": _on_mart(diagnostic.category_volume_score),
    "worst_top_category": _on_mart(diagnostic.worst_top_category),
    "category_score_spread": _on_mart(diagnostic.category_score_spread),
    "state_satisfaction": _on_mart(diagnostic.state_satisfaction),
    "state_score_residual": _on_mart(diagnostic.state_residual),
    "first_order_compare": _on_mart(diagnostic.first_order_compare),
    "installments_effect": _on_mart(diagnostic.installments_effect),
    "installments_items": _on_tables(diagnostic.installments_items),
    "freight_ratio_by_category": _on_tables(partial(diagnostic.freight_ratio, cutoff=STAR_CUTOFF)),
    "freight_volume_spearman": _on_tables(partial(diagnostic.freight_volume_spearman, cutoff=STAR_CUTOFF)),
    "order_corr_matrix": _on_mart(diagnostic.order_corr_matrix),
    # customers
    "rfm_base": _on_rfm(lambda rfm: rfm.drop("revenue"), stored=False),
    "rfm_sample": _on_rfm(_sample),
    "rfm_ntile": _on_rfm(lambda rfm: customers.rfm_ntile(rfm).drop("revenue")),
    "rfm_quantile": _on_rfm(lambda rfm: customers.rfm_quantile(rfm).drop("revenue")),
    "rfm_segments": _on_rfm(lambda rfm: _segments(rfm).drop("revenue")),
    "rfm_summary": _on_rfm(lambda rfm: customers.rfm_summary(_segments(rfm))),
    "customer_clv": _on_mart(customers.clv),
    "clv_top_decile": _on_clv(customers.clv_top_decile),
    "clv_summary": _on_clv(customers.clv_summary),
    "clv_histogram": _on_clv(customers.clv_histogram),
    "clv_top10_share": _on_clv(customers.top_share, q=0.9),
    "clv_top20_share": _on_clv(customers.top_share, q=0.8),
    "clv_by_type": _on_tables(lambda t: customers.clv_by_type(customers.clv(_mart_for(customers.clv, t)))),
    "cohort_counts": _on_mart(customers.cohort_counts),
    "cohort_retention": _on_mart(customers.cohort_retention),
    "cohort_matrix": _on_mart(customers.cohort_matrix),
    "retention_curve": _on_mart(customers.retention_curve),
    "pareto_state": _on_mart(customers.pareto_state),
    "pareto_state_no_cutoff": _on_mart(customers.pareto_state, cutoff=None),
    "pareto_state_cover80": _on_mart(customers.pareto_state_cover80),
    "pareto_customer_top20": _on_tables(
        lambda t: customers.pareto_customer_top20(customers.clv(_mart_for(customers.clv, t)))
    ),
    "seasonality_5mo": _on_mart(customers.seasonality),
    "seasonality_spike": _on_mart(customers.spike_check),
    "voucher_repeat_rate": _on_mart(customers.voucher_effect),
    "rfm_kmeans": _kmeans_rows,
    "rfm_kmeans_profile": _kmeans_profile,
    "rule_cluster_profile": _on_rfm(lambda rfm: clusters.cluster_profile(_rule_clusters(rfm))),
    # model
    "class_balance": _on_mart(feats.class_balance),
    "class_balance_unreviewed_negative": _on_mart(feats.class_balance, unreviewed="negative"),
    "model_features": _on_tables(_feature_rows),
    "model_features_v1": _on_tables(partial(_feature_rows, version=1)),
    "one_hot_features": _on_tables(_one_hot_features),
    "split_counts": _on_tables(lambda t: feats.split_counts(feats.stratified_split(_feature_rows(t)))),
    "fold_counts": _on_tables(_fold_counts),
    "rule_choice": _on_tables(_rule_choice),
    "class_weights": _on_tables(lambda t: feats.class_weights(_feature_rows(t))),
    "model_metrics": _on_tables(_rule_metrics),
    "threshold_sweep": _on_tables(lambda t: curves.threshold_sweep(_late_rule(t), feats.LABEL, "delivery_delay_days")),
    "class_report": _on_tables(lambda t: risk.class_report(_late_rule(t), prediction="is_late")),
    "model_compare": _model_compare,
    "model_tuning": _model_tuning,
    "feature_importance": _feature_importance,
    "order_risk_scores": _order_risk_scores,
}
