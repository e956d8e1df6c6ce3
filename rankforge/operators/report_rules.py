"""Stored reports taken apart into relations, and every rule that a stored report must keep.

A report's JSON becomes one VARIANT; its parts (envelope, sources, cited ids, records) are columns and exploded lists of that,
so a field of a wrong type is a null that breaks its rule, and relations join on report_id like any other tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from . import invariants, nested, provenance
from .entity import shared_folder
from .scoring import CATEGORIES

#: Names in a stored report of the audit fields, and of the score categories.
AUDIT_NAMES = dict(
    zip(
        invariants.AUDIT_FIELDS,
        (
            "h1Count", "headingCount", "wordCount", "ctaCount", "hasPhone", "hasEmail", "hasContactPage", "hasBookingOrQuote", "hasPricingPage", "hasServicesPage", "hasAboutOrTeamPage",
            "hasBlogOrNewsPage", "hasCareersPage", "hasTestimonials", "hasTrustLanguage", "hasGalleryOrCaseStudy", "hasSocialLinks", "hasViewport", "isHttps", "htmlBytes", "fetchMs", "websiteScore",
        ),
        strict=True,
    )
)
SIGNAL_LISTS = ("momentumSignals", "riskSignals", "changeSignals", "offerSignals", "hiringSignals", "newsSignals")
#: Lists of a report whose items cite sources.
CITING = ("report.topFindings", "report.topRisks", "report.competitorHighlights", "recommendations", "report.actionPlan")
REPORT_TEXT = "report_id string, payload string"


def _at(path: str, kind: str, of: str = "v") -> Column:
    """A value of the kind itself: a text that reads like a number or a truth value is none."""
    value = F.try_variant_get(of, f"$.{path}", kind)
    if kind not in ("boolean", "int", "double"):
        return value
    own = F.schema_of_variant(F.try_variant_get(of, f"$.{path}", "variant"))
    return F.when(own == "BOOLEAN" if kind == "boolean" else own.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), value)


def _list(path: str, of: str = "v") -> Column:
    return F.coalesce(_at(path, "array<variant>", of), F.array().cast("array<variant>"))


def opened(reports: DataFrame) -> DataFrame:
    """(report_id, is_json, generated_at, v, payload) of reports (report_id, payload): v is the report as VARIANT, null if there is none.

    payload stays only where ``nested.suspect``, else it is null. is_json is for a filter behind the table: before it, all is parsed twice.
    """
    r = reports.select("report_id", F.try_parse_json("payload").alias("all"), F.when(nested.suspect(F.col("payload")), F.col("payload")).alias("payload"))
    return r.select("report_id", F.col("all").isNotNull().alias("is_json"), _at("createdAt", "string", "all").alias("generated_at"), _at("report", "variant", "all").alias("v"), "payload")


def relations(r: DataFrame) -> dict[str, DataFrame]:
    """envelope, sources, citations and records of ``opened`` reports.

    A source has n, how many its report lists; a citation has unknown: whether it names an id that no source of its report has.
    """
    envelope = r.select(
        "report_id", "generated_at", _at("schemaVersion", "int").alias("schema_version"), _at("provenance.policy", "string").alias("policy"), _at("provenance.containsSyntheticData", "boolean").alias("synthetic"),
        _at("summary.scoringVersion", "int").alias("scoring_version"), F.size(_list("provenance.sources")).alias("n_sources"), _at("market.lat", "double").alias("lat"), _at("market.lon", "double").alias("lon"),
        _at("summary.competitorCount", "int").alias("competitor_count"), F.size(_list("competitors")).alias("n_competitors"), F.coalesce(_at("summary.yourRankTied", "boolean"), F.lit(False)).alias("your_tied"),
        F.coalesce(_at("user.rankTied", "boolean"), F.lit(False)).alias("user_tied"),
    )
    s = r.select("report_id", F.size(_list("provenance.sources")).alias("n"), F.posexplode(_list("provenance.sources")).alias("ord", "s"))
    text = lambda c, of="s": _at(c, "string", of)
    sources = s.select("report_id", "n", "ord", text("id").alias("source_id"), text("kind").alias("kind"), text("provider").alias("provider"), text("title").alias("title"), text("accessedAt").alias("accessed_at"), text("status").alias("status"), text("url").alias("url"), text("businessName").alias("business"))
    user = F.when(_at("user", "variant").isNotNull(), F.array(_at("user", "variant"))).otherwise(F.array().cast("array<variant>"))
    r = r.withColumn("known", F.array_compact(F.transform(_list("provenance.sources"), lambda x: F.try_variant_get(x, "$.id", "string"))))
    c = r.select("report_id", "known", _at("summary.scoringVersion", "int").alias("scoring_version"), F.posexplode(F.concat(user, _list("competitors"))).alias("ord", "c"))
    status, number = _at("auditStatus", "string", "c"), lambda p: _at(p, "double", "c")
    fields = [_at(f"websiteAudit.{n}", "string", "c").alias(f) for f, n in AUDIT_NAMES.items() if f != "website_score"]
    records = c.select(
        F.col("report_id").alias("market_id"), _at("id", "string", "c").alias("id"), "scoring_version", (status != "unavailable").alias("available"), _at("isChain", "boolean", "c").alias("is_chain"), _at("websiteAudit.skipped", "boolean", "c").alias("skipped"),
        status.alias("audit_status"), _at("websiteAudit.auditStatus", "string", "c").alias("website_status"), _at("signals.auditStatus", "string", "c").alias("signal_status"), _at("rank", "int", "c").alias("rank"), _at("rankTied", "boolean", "c").alias("tied"),
        number("categoryMatchScore").alias("category_match"), number("localPresenceScore").alias("local_presence"), number("websiteAudit.websiteScore").alias("website_score"), number("signals.momentumScore").alias("momentum"),
        number("signals.riskScore").alias("risk"), number("signals.changeScore").alias("change"), number("finalScore").alias("final_score"), *fields, *[number(f"websiteAudit.scoreBreakdown.{n}").alias(n) for n, _ in CATEGORIES],
    )
    ids = lambda p, of: _at(f"{p}sourceIds", "array<string>", of)
    own = F.struct(F.lit("market").alias("label"), F.lit(True).alias("required"), ids("market.", "v").alias("source_ids"))
    cited = lambda items, label: F.transform(items, lambda x: F.struct(label.alias("label"), F.lit(True).alias("required"), F.try_variant_get(x, "$.sourceIds", "array<string>").alias("source_ids")))
    listed = [cited(_list(p), F.lit(p)) for p in CITING]
    seen = lambda p: F.coalesce(_at(f"{p}auditStatus", "string", "c"), F.lit("")) != "unavailable"
    whose = F.concat(F.coalesce(_at("id", "string", "c"), F.lit("?")), F.lit(" "))
    by = [("", F.lit(True)), ("websiteAudit.", seen("")), ("signals.", seen("signals."))]
    mine = [F.struct(F.concat(whose, F.lit(p or "record")).alias("label"), need.alias("required"), ids(p, "c").alias("source_ids")) for p, need in by]
    inner = [cited(_list(p, "c"), F.concat(whose, F.lit(p))) for p in ("websiteAudit.evidence", *(f"signals.{n}" for n in SIGNAL_LISTS))]
    citations = r.select("report_id", "known", F.inline(F.concat(F.array(own), *listed))).unionByName(c.select("report_id", "known", F.inline(F.concat(F.array(*mine), *inner))))
    citations = citations.withColumn("unknown", F.size(F.array_except("source_ids", "known")) > 0).drop("known")
    return {"envelope": envelope, "sources": sources, "citations": citations, "records": records}


def report_rules(reports: DataFrame) -> DataFrame:
    """(report_id, part, rule) of every rule that a stored report breaks; a sound one has no row. reports: report_id, payload.

    Envelope, numbered sources without repeats, cited ids, states and scores of records, ranks with ties (scoring version 2), and the fields
    that no report may have. Reports of version 1 keep the rules of their states and scores; their ranks aren't checked.
    """
    return _broken_rules(reports).distinct()


def _broken_rules(reports: DataFrame) -> DataFrame:
    """``report_rules`` in which a row may repeat."""
    spark, where = reports.sparkSession, f"{shared_folder(reports.sparkSession)}/rankforge/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    r = kept(opened(reports), "opened").where("is_json")  # payloads are parsed once
    rel = relations(r)
    suspects = r.select("report_id", "payload").where("payload IS NOT NULL")
    e, c = rel["envelope"], rel["citations"]
    s, r = (kept(rel[name], name) for name in ("sources", "records"))  # each is read by several rules
    add = lambda df, rule=None: df.select("report_id", "part", F.lit(rule).alias("rule") if rule else F.col("rule"))
    summary = {"competitor_count": ~F.col("competitor_count").eqNullSafe(F.col("n_competitors")), "your_tied": (F.col("scoring_version") == 2) & (F.col("your_tied") != F.col("user_tied"))}
    both = (("envelope", invariants.envelope_rules()), ("summary", summary))
    hits = F.array(*[F.struct(F.lit(part).alias("part"), F.when(bad, rule).alias("rule")) for part, rules in both for rule, bad in rules.items()])
    out = e.select("report_id", F.inline(F.filter(hits, lambda x: x["rule"].isNotNull())))
    name = F.coalesce("source_id", F.lit("?"))
    out = out.union(add(invariants.source_row_violations(s).withColumn("part", name)))
    out = out.union(add(s.where(~F.col("source_id").eqNullSafe(F.concat(F.lit("S"), (F.col("ord") + 1).cast("string")))).withColumn("part", name), "not_sequential"))
    said = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    url = F.coalesce(canonical_url(F.col("url")), F.lit(""))
    keyed = s.where("n > 1").withColumn("_url", url).withColumn("_key", F.struct("kind", "provider", "_url", said("title").alias("t"), said("business").alias("b")))
    last = F.max_by(name, "ord").alias("part")
    out = out.union(add(keyed.where("_url <> ''").groupBy("report_id", "_url").agg(last, F.count("*").alias("n")).where("n > 1"), "url_twice"))
    out = out.union(add(keyed.groupBy("report_id", "_key").agg(last, F.count("*").alias("n")).where("n > 1"), "source_twice"))
    out = out.union(add(invariants.citation_violations(c).withColumnRenamed("label", "part")))
    # a record's market is its report with the version of its rules, so each check is planned once
    r = r.withColumn("market_id", F.struct(F.col("market_id").alias("report_id"), F.col("scoring_version").eqNullSafe(2).alias("new"))).drop("scoring_version")
    r = r.withColumn("signal_status", F.when(F.col("signal_status").eqNullSafe(F.col("website_status")), F.col("signal_status"))).withColumn("scored", F.col("final_score").isNotNull())
    broken = invariants.record_state_violations(r).union(provenance.record_violations(r)).where(F.col("market_id.new") | ~F.col("rule").isin("tied", "chain_scored", "rank", "rank_of_unscored"))
    out = out.union(broken.select("market_id.report_id", F.coalesce("id", F.lit("?")), "rule"))
    return out.union(nested.synthetic_fields(suspects).select("report_id", F.col("path").alias("part"), "rule"))


def checked_status(reports: DataFrame) -> DataFrame:
    """``report_status`` where a report that breaks any rule is invalid, with the names of its broken rules. reports: report_id, payload.

    Stored envelopes name their version ``schemaVersion``.
    """
    v = F.try_parse_json("payload")
    at = lambda p, kind: F.try_variant_get("_v", f"$.{p}", kind)
    ok = at("id", "string").eqNullSafe(F.col("report_id")) & F.try_to_timestamp(at("createdAt", "string")).isNotNull() & at("report", "variant").isNotNull()
    head = F.when(F.col("payload").isNull(), "missing").when(F.col("_v").isNull() | at("schemaVersion", "int").isNull(), "legacy").when((at("schemaVersion", "int") == 2) & ok, "ok").otherwise("invalid")
    first = reports.withColumn("_v", v).withColumn("status", head).drop("_v")
    broken = _broken_rules(reports).groupBy("report_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    both = first.join(broken, "report_id", "left").withColumn("rules", F.when(F.col("status") == "ok", F.col("rules")))
    return both.withColumn("status", F.when(F.size("rules") > 0, "invalid").otherwise(F.col("status"))).withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
