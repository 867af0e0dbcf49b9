"""Sequences of a site as table-in, table-out functions: sign-in, registration, posting, moderation and deletion.

Each takes the requests of a batch and the tables they meet, and returns one row for each request with its outcome, or the
next state of the tables. Checks are ordered columns, so the first that fails names the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoraflow.operators import dml
from agoraflow.operators.policy import first_error

#: What a name or a mailbox may look like.
MAILBOX = r"^[a-zA-Z0-9][a-zA-Z0-9.\-_]{0,63}$"


def signed_in(attempts: DataFrame, users: DataFrame, mute_after: int) -> DataFrame:
    """attempts (name, secret) against users (id, username, email, secret_hash, verified, failed): unknown, muted, wrong, unverified
    or ok, and the failures that the user has afterwards: one more if the secret is wrong, none after a success."""
    names = users.select("id", F.lower("username").alias("_n"), "secret_hash", "verified", "failed").unionByName(users.select("id", F.lower("email").alias("_n"), "secret_hash", "verified", "failed")).where(F.col("_n").isNotNull()).dropDuplicates(["_n", "id"])
    met = attempts.join(names, F.lower(attempts["name"]) == names["_n"], "left")
    outcome = first_error(
        (F.col("id").isNull(), "unknown"), (F.col("failed") >= mute_after, "muted"),
        (~F.col("secret_hash").eqNullSafe(F.sha2("secret", 256)), "wrong"), (~F.col("verified"), "unverified"),
    )
    out = met.withColumn("outcome", F.coalesce(outcome, F.lit("ok")))
    after = F.when(F.col("outcome") == "wrong", F.col("failed") + 1).when(F.col("outcome") == "ok", 0).otherwise(F.col("failed"))
    return out.withColumn("failed_after", after).drop("_n", "secret_hash", "secret")


def registered(requests: DataFrame, users: DataFrame, as_of: Column, least_age: int, most_age: int, years: int = 31_557_600) -> DataFrame:
    """requests (username, password, repeat, mailbox, birth) with the first thing wrong with them, or null where they may join users."""
    taken = users.select(F.lower("username").alias("_u")).where("_u IS NOT NULL").distinct()
    boxes = users.select(F.lower("mailbox").alias("_m")).where("_m IS NOT NULL").distinct()
    met = requests.join(taken, F.lower(requests["username"]) == taken["_u"], "left").join(boxes, F.lower(requests["mailbox"]) == boxes["_m"], "left")
    age = aged(F.col("birth"), as_of)
    wrong = first_error(
        (F.coalesce("username", F.lit("")) == "", "empty name"), (~F.col("username").rlike(r"^[A-Za-z0-9_#]{3,32}$"), "bad name"), (F.col("_u").isNotNull(), "name taken"),
        (F.coalesce("password", F.lit("")) == "", "empty password"), (F.length("password") < 8, "short password"), (~F.col("password").eqNullSafe(F.col("repeat")), "no match"),
        (F.col("mailbox").isNotNull() & ~F.col("mailbox").rlike(MAILBOX), "bad mailbox"), (F.col("_m").isNotNull(), "mailbox taken"),
        (F.col("birth").isNull(), "no birth"), (age < least_age * years, "too young"), (age > most_age * years, "too old"),
    )
    return met.withColumn("error", wrong).drop("_u", "_m")


def aged(birth: Column, as_of: Column) -> Column:
    """Seconds since birth."""
    return F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(birth.cast("timestamp"))


def password_changed(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests (id, old, new, repeat, unlocked) against users (id, secret_hash): the first error, and the hash afterwards."""
    met = requests.join(users.select("id", "secret_hash"), "id", "left")
    wrong = first_error(
        (~F.col("new").eqNullSafe(F.col("repeat")), "no match"), (F.coalesce("new", F.lit("")) == "", "empty"), (F.length("new") < 8, "short"),
        (F.col("secret_hash").isNull(), "unknown"), (~F.col("unlocked") & (F.sha2("old", 256) != F.col("secret_hash")), "wrong"),
    )
    return met.withColumn("error", wrong).withColumn("hash_after", F.when(wrong.isNull(), F.sha2("new", 256)).otherwise(F.col("secret_hash"))).drop("old", "new", "repeat", "secret_hash")


def recovered(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests (asked) with the id of the user who has that name or address, whatever its case; deleted users are not found."""
    own = users.where(~F.col("deleted"))
    names = own.select("id", F.lower("username").alias("_n")).unionByName(own.select("id", F.lower("email").alias("_n"))).where("_n IS NOT NULL").groupBy("_n").agg(F.min("id").alias("id"))
    return requests.join(names, F.lower("asked") == F.col("_n"), "left").drop("_n")


def posted(posts: DataFrame, comments: DataFrame, mutes: DataFrame, spam: list[str], gap: int) -> DataFrame:
    """posts (post_id, user_id, page, content, email, reply_to, allowed, at, last_at) with the outcome of the checks in their order:
    permission, empty text, address, reply known, reply on the same page, spam, mute, flood; posted where all pass.

    comments has id and page; mutes has user_id and until, at whose very instant a mute is over.
    """
    known = comments.select(F.col("id").alias("_c"), F.col("page").alias("_p"))
    muted = mutes.groupBy(F.col("user_id").alias("_u")).agg(F.max("until").alias("_until"))
    met = posts.join(known, F.col("reply_to") == F.col("_c"), "left").join(muted, F.col("user_id") == F.col("_u"), "left")
    bad = F.lit(False)
    for pattern in spam:
        bad = bad | F.col("content").rlike(pattern)
    wrong = first_error(
        (~F.col("allowed"), "forbidden"), (F.trim("content") == "", "empty"), (F.col("email").isNotNull() & ~F.col("email").contains("@"), "bad email"),
        (F.col("reply_to").isNotNull() & F.col("_c").isNull(), "no such comment"), (F.col("reply_to").isNotNull() & (F.col("_p") != F.col("page")), "other page"),
        (bad, "spam"), (F.col("_until") > F.col("at"), "muted"), ((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) < gap * 1_000_000, "flood"),
    )
    return met.withColumn("outcome", F.coalesce(wrong, F.lit("posted"))).drop("_c", "_p", "_u", "_until")


def muted_after(outcomes: DataFrame, seconds: int) -> DataFrame:
    """(user_id, until): the mutes that spam brings, one for each user, from the last violation on."""
    return outcomes.where("outcome = 'spam'").groupBy("user_id").agg((F.max("at") + F.make_interval(secs=F.lit(seconds))).alias("until"))


def moderated(comments: DataFrame, actions: DataFrame) -> DataFrame:
    """comments (id, hidden, flagged, content) after actions (id, action, content): update, hide, unhide, flag, unflag or delete.
    One action for each comment; others, and unknown ones, change nothing."""
    known = actions.where(F.col("action").isin("update", "hide", "unhide", "flag", "unflag", "delete"))
    met = comments.join(known.select("id", F.col("action").alias("_a"), F.col("content").alias("_c")), "id", "left")
    a = F.coalesce("_a", F.lit(""))
    out = met.where(a != "delete").withColumns({
        "hidden": F.when(a == "hide", True).when(a == "unhide", False).otherwise(F.col("hidden")),
        "flagged": F.when(a == "flag", True).when(a == "unflag", False).otherwise(F.col("flagged")),
        "content": F.when(a == "update", F.col("_c")).otherwise(F.col("content")),
    })
    return out.drop("_a", "_c")


#: What stays of a user under each mode of deletion.
MODES = ("full", "hard_redact", "soft_redact", "keep_visible", "keep_suspended")


def removed(users: DataFrame, comments: DataFrame, requests: DataFrame, ghost: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, comments, outcomes) after requests (id, mode, secret, unlocked, by_admin) are carried out.

    A request needs the user's secret, an unlock token or an admin; else it is refused. full takes the user and leaves its
    comments without owner; hard_redact gives its comments to the ghost and clears the row; soft_redact clears the row but keeps
    the owner; keep_visible and keep_suspended only mark it, the latter as unable to sign in.
    """
    met = requests.join(users.select("id", "secret_hash"), "id", "left")
    wrong = first_error((F.col("secret_hash").isNull(), "unknown"), (~F.col("mode").isin(*MODES), "bad mode"), (~(F.col("by_admin") | F.col("unlocked") | F.sha2("secret", 256).eqNullSafe(F.col("secret_hash"))), "refused"))
    outcomes = met.select("id", "mode", F.coalesce(wrong, F.lit("done")).alias("outcome"))
    done = outcomes.where("outcome = 'done'").select("id", F.col("mode").alias("_m"))
    left = users.join(done, "id", "left").where("_m IS NULL OR _m <> 'full'")
    redacted = F.coalesce(F.col("_m").isin("hard_redact", "soft_redact"), F.lit(False))
    left = dml.tombstoned(left, redacted, "id", "username", ["email", "display_name"])
    left = dml.updated(left, F.col("_m").isNotNull(), deleted=True)
    left = dml.updated(left, F.col("_m") == "keep_suspended", verified=False).drop("_m")
    owned = comments.join(done.select(F.col("id").alias("user_id"), "_m"), "user_id", "left")
    owner = F.when(F.col("_m") == "hard_redact", F.lit(ghost)).when(F.col("_m") == "full", F.lit(None)).otherwise(F.col("user_id"))
    return left, owned.withColumn("user_id", owner.cast(comments.schema["user_id"].dataType)).drop("_m"), outcomes


def saved_levels(current: DataFrame, asked: DataFrame, levels: list[int]) -> DataFrame:
    """The overrides (code, level) that asked (code, text) leave behind: all of `current` goes, valid non-empty levels come, the last
    of a code by its number n."""
    level = F.col("text").try_cast("int")
    good = asked.where((F.trim("text") != "") & level.isin(*levels)).withColumn("level", level)
    return current.limit(0).select("code", "level").unionByName(dml.latest(good, ["code"], "n").select("code", "level"))


def rotation_due(sessions: DataFrame, at: str, last: str, intervals: dict[str, int], default: int) -> DataFrame:
    """sessions (kind, forced, at, last) with whether their id is to change: by force, or when the interval of their kind has passed."""
    limit = F.lit(default)
    for kind, seconds in intervals.items():
        limit = F.when(F.col("kind") == kind, seconds).otherwise(limit)
    passed = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(last).cast("timestamp")) >= limit * 1_000_000
    return sessions.withColumn("due", F.col("forced") | F.coalesce(passed, F.lit(False)))
