"""Who may read what. Visibility is a union of equi-joins, never a join of every viewer with every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.constants import COMMUNITY_UNLOCK, SEARCHABLE


def searchable(e: DataFrame) -> DataFrame:
    return e.where(F.col("review_status").isin(*SEARCHABLE) & (F.col("extraction_status") == "done") & ~F.coalesce("revoked", F.lit(False)))


def acl_kind(acl: Column) -> Column:
    """private, public or team; ``org`` is public, what cannot be read is private."""
    return F.when(acl.isin("public", "org"), "public").when(acl.rlike(r"^team:.+$"), "team").otherwise("private")


def acl_team(acl: Column) -> Column:
    return F.when(acl.rlike(r"^team:.+$"), F.regexp_extract(acl, r"^team:(.+)$", 1))


def ingest_acl(acl: Column) -> Column:
    """On ingest only private and team:X survive."""
    return F.when(acl.rlike(r"^team:.+$"), acl).otherwise("private")


def ingest_status(flagged: Column, acl: Column) -> Column:
    """Review waits only for rows that others could read."""
    return F.when((flagged == "human_review") & (ingest_acl(acl) != "private"), "pending").otherwise("auto_approved")


def owner_name(owner: Column, name: Column) -> Column:
    return F.when(owner.isNull() | (owner == ""), name).otherwise(owner)


def visible_rows(viewers: DataFrame, rows: DataFrame, agents: DataFrame) -> DataFrame:
    """``(viewer_id, experience_id, how)`` for own, team and shared rows; public rows only once published.

    Shared rows are the same for every viewer and are marked once, with a null viewer.
    """
    live = rows.where(~F.coalesce("revoked", F.lit(False)))
    who = agents.select("agent_id", "team", owner_name(F.col("owner"), F.col("name")).alias("owner"))
    own = viewers.join(who, viewers.viewer_id == who.agent_id).select("viewer_id", "team", "owner")
    of = live.join(who.select("agent_id", F.col("owner").alias("row_owner"), F.col("team").alias("owner_team")), "agent_id")
    mine = own.join(of, own.owner == of.row_owner).select("viewer_id", "experience_id", F.lit("own").alias("how"))
    teams = live.where(acl_kind(F.col("acl")) == "team").select("experience_id", acl_team(F.col("acl")).alias("acl_team"))
    team = own.join(teams, own.team == teams.acl_team).select("viewer_id", "experience_id", F.lit("team").alias("how"))
    shared = live.where((acl_kind(F.col("acl")) == "public") & (F.col("publish_status") == "published"))
    return mine.unionByName(team).unionByName(shared.select(F.lit(None).cast("long").alias("viewer_id"), "experience_id", F.lit("shared").alias("how")))


def visible_counts(viewers: DataFrame, rows: DataFrame, agents: DataFrame) -> DataFrame:
    """``(viewer_id, how, n, ids)``: numbers and id sums of ``visible_rows``, from one row an owner and one a team, never a row a viewer and visible row."""
    live = rows.where(~F.coalesce("revoked", F.lit(False)))
    who = agents.select("agent_id", "team", owner_name(F.col("owner"), F.col("name")).alias("owner"))
    sums = [F.count("*").alias("n"), F.sum("experience_id").alias("ids")]
    own = viewers.join(who, viewers.viewer_id == who.agent_id).select("viewer_id", "team", "owner")
    by_owner = live.join(who.select("agent_id", "owner"), "agent_id").groupBy("owner").agg(*sums)
    by_team = live.where(acl_kind(F.col("acl")) == "team").groupBy(acl_team(F.col("acl")).alias("team")).agg(*sums)
    shared = live.where((acl_kind(F.col("acl")) == "public") & (F.col("publish_status") == "published")).groupBy(F.lit("shared").alias("how")).agg(*sums)
    out = own.join(by_owner, "owner").select("viewer_id", F.lit("own").alias("how"), "n", "ids")
    out = out.unionByName(own.join(by_team, "team").select("viewer_id", F.lit("team").alias("how"), "n", "ids"))
    return out.unionByName(shared.select(F.lit(None).cast("long").alias("viewer_id"), "how", "n", "ids"))


def row_scope(rows: DataFrame, viewer: str, viewer_owner: str, unlocked: bool, grants: DataFrame) -> DataFrame:
    """personal, project, community or null for one viewer: projects hide high sensitivity unless granted, the community is for unlocked owners."""
    g = grants.select(F.col("owner").alias("__owner"), "include_high")
    rows = rows.join(F.broadcast(g) if grants.limit(10_001).count() <= 10_000 else g, rows.owner == F.col("__owner"), "left")
    project = F.col("__owner").isNotNull() & ((F.col("sensitivity") != "high") | F.col("include_high"))
    community = F.lit(unlocked) & (acl_kind(F.col("acl")) == "public") & (F.col("publish_status") == "published")
    scope = F.when(F.col("owner") == viewer_owner, "personal").when(project, "project").when(community, "community")
    return rows.withColumn("scope", scope).drop("__owner", "include_high")


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(~F.coalesce("revoked", F.lit(False)) & (F.col("acl") == "public") & (F.col("publish_status") == "published") & F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()


def browse(rows: DataFrame, review: str | None = None, task: str | None = None, sensitivity: str | None = None, search: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Published public rows, newest first (then by id)."""
    out = rows.where((F.col("acl") == "public") & (F.col("publish_status") == "published") & ~F.coalesce("revoked", F.lit(False)))
    for column, value in (("review_status", review), ("task_type", task), ("sensitivity", sensitivity)):
        if value and value != "all":
            out = out.where(F.col(column) == value)
    if search and search.strip():
        out = out.where(F.col("intent_text").contains(search.strip()) | F.col("experience_id").cast("string").contains(search.strip()))
    return out.orderBy(F.desc("created_at"), "experience_id").offset(offset).limit(limit)


def owner_quota(events: DataFrame) -> DataFrame:
    """Publish events count per owner and never go down; three unlock the community."""
    n = events.groupBy("owner").agg(F.count(F.when(F.col("action") == "publish", 1)).alias("publish_count"), F.count(F.when(F.col("action") == "unpublish", 1)).alias("unpublished_count"))
    return n.withColumn("unlocked", F.col("publish_count") >= COMMUNITY_UNLOCK).withColumn("remaining", F.greatest(F.lit(0), COMMUNITY_UNLOCK - F.col("publish_count")))


def publish(rows: DataFrame, requests: DataFrame, hits: DataFrame) -> DataFrame:
    """A batch of publish requests ``(experience_id, owner)`` against strict-check ``hits`` (one row a hit): verdict and reason."""
    bad = hits.groupBy("experience_id").agg(F.count("*").alias("n_hits"))
    r = requests.withColumnRenamed("owner", "asked_by").join(rows.select("experience_id", "owner", "acl", "publish_status", "revoked"), "experience_id", "left").join(bad, "experience_id", "left")
    reason = (
        F.when(F.col("owner").isNull(), "not_found").when(F.col("owner") != F.col("asked_by"), "not_owner").when(F.col("revoked"), "revoked")
        .when((F.col("acl") == "public") & (F.col("publish_status") == "published"), "already_public").when(F.col("n_hits") > 0, "strict_check")
    )
    return r.select("experience_id", "asked_by", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce(reason, F.lit("published")).alias("verdict"))


def cascade(table: DataFrame, revoked: DataFrame) -> DataFrame:
    """A dependent table without the rows of revoked experiences."""
    return table.join(revoked.select("experience_id"), "experience_id", "left_anti")


def revoke(rows: DataFrame, revoked: DataFrame) -> DataFrame:
    gone = revoked.select("experience_id", F.lit(True).alias("__gone")).distinct()
    rows = rows.join(gone, "experience_id", "left")
    hit = F.coalesce("__gone", F.lit(False))
    return rows.withColumn("revoked", F.coalesce("revoked", F.lit(False)) | hit).withColumn("review_status", F.when(hit, "revoked").otherwise(F.col("review_status"))).drop("__gone")
