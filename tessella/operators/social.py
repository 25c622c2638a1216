"""Follower graph, posts and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.functions import text as fx
from tessella.operators.keyed import erase, put, strict_lookup
from tessella.operators.windows import timeline_slice

NEWEST = (F.desc, "timestamp"), (F.desc, "post_id")


def _newest() -> list[Column]:
    return [f(c) for f, c in NEWEST]


def follow(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Adds directed edges; repeats change nothing."""
    return edges.unionByName(new).distinct()


def unfollow(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Takes out directed edges."""
    return edges.join(gone, ["src", "dst"], "left_anti")


def replay(log: DataFrame) -> DataFrame:
    """Edges after a log (seq, op, src, dst): the last operation on an edge counts."""
    last = log.groupBy("src", "dst").agg(F.max_by("op", "seq").alias("op"))
    return last.filter(F.col("op") == "follow").select("src", "dst")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def followers(edges: DataFrame) -> DataFrame:
    """Per user the ascending list of those who follow them."""
    return edges.groupBy(F.col("dst").alias("user_id")).agg(F.sort_array(F.collect_set("src")).alias("followers"))


def followees(edges: DataFrame) -> DataFrame:
    """Per user the ascending list of those they follow."""
    return edges.groupBy(F.col("src").alias("user_id")).agg(F.sort_array(F.collect_set("dst")).alias("followees"))


def follow_by_name(edges: DataFrame, names: DataFrame, users: DataFrame) -> DataFrame:
    """Follows by name (a, b); pairs with an unknown name do nothing."""
    u = users.filter(F.col("user_id") != 0).select("username", "user_id")
    pairs = names.join(u.withColumnRenamed("username", "a").withColumnRenamed("user_id", "src"), "a").join(u.withColumnRenamed("username", "b").withColumnRenamed("user_id", "dst"), "b")
    return follow(edges, pairs.select("src", "dst"))


def unfollow_by_name(edges: DataFrame, names: DataFrame, users: DataFrame) -> DataFrame:
    """The opposite of follow_by_name."""
    return unfollow(edges, follow_by_name(edges.limit(0), names, users))


def fan_out(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """Home timeline entries (user_id, timestamp, post_id): followers of the author and those mentioned, each once.
    posts: post_id (unique), user_id, timestamp, mentions array<bigint>; edges: a set.

    Mentions of followers are left out before the union, so the entries, by far the largest table here, are never
    grouped. An author with very many followers is split by the skew join of adaptive execution.
    """
    to_followers = posts.select("post_id", "timestamp", F.col("user_id").alias("dst")).join(edges, "dst").select(F.col("src").alias("user_id"), "timestamp", "post_id")
    mentioned = posts.select(F.explode(F.array_distinct("mentions")).alias("src"), F.col("user_id").alias("dst"), "timestamp", "post_id")
    others = mentioned.join(edges, ["src", "dst"], "left_anti").select(F.col("src").alias("user_id"), "timestamp", "post_id")
    return to_followers.unionByName(others)


def read_home_timeline(posts: DataFrame, edges: DataFrame, start: int, stop: int) -> DataFrame:
    """Entries start..stop-1 of every home timeline, newest first, with their posts.

    An entry among a user's newest `stop` is among the newest `stop` of its author, or of those that mention the
    user. So posts are cut per author and per mentioned user before the fan-out, whose size is then bounded by
    followers times `stop`, however much an author has posted.
    """
    if start < 0 or stop <= start:
        return read_timeline(user_timeline(posts), posts.drop("mentions"), start, stop)
    entries = posts.select("post_id", "user_id", "timestamp")
    newest = latest(entries, stop).withColumn("mentions", F.array().cast("array<bigint>"))
    named = posts.select(F.explode(F.array_distinct("mentions")).alias("user_id"), "timestamp", "post_id", F.col("user_id").alias("dst"))
    others = latest(named, stop).join(edges.withColumnRenamed("src", "user_id"), ["user_id", "dst"], "left_anti").drop("dst")
    return read_timeline(fan_out(newest, edges).unionByName(others), posts.drop("mentions"), start, stop)


def user_timeline(posts: DataFrame) -> DataFrame:
    """A user's own posts as timeline entries."""
    return posts.select("user_id", "timestamp", "post_id")


def read_timeline(entries: DataFrame, posts: DataFrame, start: int, stop: int, user_id: int | None = None) -> DataFrame:
    """Entries start..stop-1, newest first, with their posts; posts that are gone are skipped."""
    mine = entries if user_id is None else entries.filter(F.col("user_id") == user_id)
    cut = timeline_slice(mine, "user_id", _newest(), start, stop)
    body = posts.drop("user_id", "timestamp")
    return cut.join(body, "post_id", "inner")


def remove_posts(posts: DataFrame, entries: DataFrame, home: DataFrame, user_id: int, start: int, stop: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Takes a slice of a user's timeline out of the posts, the user timelines and the home timelines."""
    gone = timeline_slice(entries.filter(F.col("user_id") == user_id), "user_id", _newest(), start, stop).select("post_id")
    return erase(posts, gone, "post_id"), erase(entries, gone, "post_id"), erase(home, gone, "post_id")


def first_score(entries: DataFrame) -> DataFrame:
    """Insert-if-absent on timelines: the first timestamp of a post stays."""
    return entries.groupBy("user_id", "post_id").agg(F.min("timestamp").alias("timestamp"))


def compose(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Posts from requests (post_id, user_id, username, text, media_ids, media_types, post_type, timestamp).

    Links are shortened, mentions resolved (an unknown name raises), media zipped.
    """
    named = requests.withColumn("__u", fx.extract_urls(F.col("text"))).withColumn("__s", F.transform("__u", lambda u: fx.short_url(u)))
    names = named.select("post_id", F.posexplode(fx.extract_mentions(F.col("text"))).alias("i", "username"))
    found = strict_lookup(names, users.select("username", "user_id"), "username", "unknown user mentioned")
    mentions = found.groupBy("post_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "user_id", "username"))), lambda m: F.struct(m.user_id.alias("user_id"), m.username.alias("username"))).alias("user_mentions"))
    media = F.arrays_zip(F.col("media_ids").alias("media_id"), F.col("media_types").alias("media_type"))
    empty = F.array().cast("array<struct<user_id:bigint,username:string>>")
    return named.join(mentions, "post_id", "left").select(
        "post_id",
        F.struct("user_id", "username").alias("creator"),
        fx.shorten_text(F.col("text"), F.col("__s")).alias("text"),
        F.coalesce("user_mentions", empty).alias("user_mentions"),
        F.when(F.size("media_ids") == F.size("media_types"), media).otherwise(F.raise_error(F.lit("media ids and types differ in number"))).alias("media"),
        F.zip_with("__s", "__u", lambda s, u: F.struct(s.alias("shortened_url"), u.alias("expanded_url"))).alias("urls"),
        "timestamp",
        "post_type",
    )


def register(users: DataFrame, new: DataFrame) -> DataFrame:
    """Registers users (user_id, first_name, last_name, username, password, salt); a name taken before is replaced."""
    made = new.withColumn("password_hashed", fx.salted_sha256(F.col("password"), F.col("salt"))).drop("password")
    return put(users, made.select(*users.columns), "username")


def login(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Per attempt (username, password): OK, NOT_REGISTERED or WRONG_PASSWORD."""
    joined = attempts.join(users.select("username", "user_id", "password_hashed", "salt"), "username", "left")
    right = fx.salted_sha256(F.col("password"), F.col("salt")) == F.col("password_hashed")
    status = F.when(F.col("user_id").isNull(), "NOT_REGISTERED").when(right, "OK").otherwise("WRONG_PASSWORD")
    return joined.select("username", F.when(status == "OK", F.col("user_id")).alias("user_id"), status.alias("status"))


def upload_media(store: DataFrame, new: DataFrame) -> DataFrame:
    """Puts blobs (filename, data)."""
    return put(store, new, "filename")


def get_media(store: DataFrame, names: DataFrame) -> DataFrame:
    """Blobs by name; an unknown name gives empty data."""
    return names.join(store, "filename", "left").withColumn("data", F.coalesce("data", F.lit(bytearray())))


def latest(entries: DataFrame, n: int) -> DataFrame:
    """The n newest entries of every user."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(*_newest()))
    return entries.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
