"""Community text: posts, comments and threads from JSON lines, and their graph."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.model import make_edges, make_nodes

POST_SCHEMA = "id string, author string, title string, selftext string, created_utc string, created string, score long, ups long, downs long, num_comments long, link_flair_text string, permalink string, url string, over_18 boolean"
COMMENT_SCHEMA = "id string, author string, body string, link_id string, parent_id string, created_utc string, score long, ups long, downs long, controversiality long"
THREAD_SCHEMA = "thread_id string, title string, category string, thread_url string, reply_count long, view_count long"
THREAD_POST_SCHEMA = "post_id string, thread_id string, author string, content_text string, timestamp_iso string, created_utc string, page_number long"
# Authors that are none.
DELETED = ("[deleted]", "[removed]", "")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are no JSON come out without an id and are dropped later. ``file`` is the file's name."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))


def forum_of_file(name: Column) -> Column:
    """The forum that a file's name carries: r_<forum>_posts.jsonl or <forum>_comments.jsonl."""
    stem = F.regexp_replace(name, r"\.(jsonl?|ndjson)(\.gz)?$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(stem, r"^r_", ""), r"_(posts|comments|submissions)$", ""))


def author_or_null(author: Column) -> Column:
    return F.when(~F.trim(author).isin(*DELETED), F.trim(author))


def epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.try_cast("double"))


def thing_id(thing: Column) -> Column:
    """t3_x is a post, t1_x a comment."""
    rest = F.substring(thing, 4, 1 << 20)
    return F.when(F.startswith(thing, F.lit("t3_")), F.concat(F.lit("reddit_post:"), rest)).when(F.startswith(thing, F.lit("t1_")), F.concat(F.lit("reddit_comment:"), rest)).otherwise(thing)


def normalise_posts(raw: DataFrame, *, keywords: list[str] | None = None) -> DataFrame:
    """Posts with an id and a time; with keywords, those with any of them in title or text."""
    forum = forum_of_file(F.col("file"))
    posts = raw.select(
        F.concat(F.lit("reddit_post:"), F.trim("id")).alias("post_id"), forum.alias("forum"), author_or_null(F.col("author")).alias("author"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("selftext", F.lit("")).alias("body"),
        F.coalesce(epoch(F.col("created_utc")), epoch(F.col("created"))).alias("created"), "score", "ups", "downs", "num_comments", F.nullif(F.trim("link_flair_text"), F.lit("")).alias("flair"), "url", F.coalesce("over_18", F.lit(False)).alias("over_18"),
    ).where("post_id <> 'reddit_post:' and created is not null")
    if keywords:
        text = F.lower(F.concat_ws("\n", "title", "body"))
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(text, F.lit(k.lower()))
        posts = posts.where(hit)
    return posts.withColumn("user_id", F.when(F.col("author").isNotNull(), F.concat_ws(":", F.lit("reddit"), "forum", "author")))


def normalise_comments(raw: DataFrame, *, kept_posts: DataFrame | None = None) -> DataFrame:
    """Comments with an id, a time and a root post; with ``kept_posts``, those of them."""
    rows = raw.where("trim(id) <> '' and trim(link_id) <> ''").select(
        F.concat(F.lit("reddit_comment:"), F.trim("id")).alias("comment_id"), forum_of_file(F.col("file")).alias("forum"), thing_id(F.col("link_id")).alias("post_id"), thing_id(F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), "link_id")).alias("parent_id"),
        author_or_null(F.col("author")).alias("author"), F.coalesce("body", F.lit("")).alias("body"), epoch(F.col("created_utc")).alias("created"), "score", "ups", "downs", "controversiality",
    ).where("created is not null")
    rows = rows.withColumn("user_id", F.when(F.col("author").isNotNull(), F.concat_ws(":", F.lit("reddit"), "forum", "author")))
    return rows if kept_posts is None else rows.join(kept_posts.select("post_id"), "post_id", "left_semi")


def first_seen(*rows: DataFrame) -> DataFrame:
    """(user_id, author, first_seen): users at their earliest sighting."""
    every = rows[0].select("user_id", "author", "created")
    for r in rows[1:]:
        every = every.unionByName(r.select("user_id", "author", "created"))
    return every.where("user_id is not null").groupBy("user_id").agg(F.min_by("author", "created").alias("author"), F.min("created").alias("first_seen"))


def normalise_threads(threads: DataFrame, posts: DataFrame, *, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(threads, posts): threads of a category and their posts; the earliest post of a thread is its root."""
    kept = threads.where("trim(thread_id) <> ''").where(F.lit(True) if category is None else F.col("category") == category)
    kept = kept.select(F.concat(F.lit("sdn_thread:"), "thread_id").alias("thread_id"), "title", "category", F.col("thread_url").alias("url"), "reply_count", "view_count")
    created = F.coalesce(F.try_to_timestamp("timestamp_iso"), epoch(F.col("created_utc")))
    rows = posts.where("trim(post_id) <> ''").select(
        F.concat_ws(":", F.lit("sdn_post"), "thread_id", "post_id").alias("post_id"), F.concat(F.lit("sdn_thread:"), "thread_id").alias("thread_id"), author_or_null(F.col("author")).alias("author"),
        F.coalesce("content_text", F.lit("")).alias("body"), created.alias("created"), "page_number",
    ).where("created is not null").join(kept.select("thread_id", "category", F.col("title").alias("thread_title")), "thread_id")
    roots = rows.groupBy("thread_id").agg(F.min(F.struct("created", "post_id")).alias("__r")).select("thread_id", F.col("__r.post_id").alias("root_post_id"))
    rows = rows.join(roots, "thread_id").withColumn("user_id", F.when(F.col("author").isNotNull(), F.concat_ws(":", F.lit("sdn"), "author")))
    return kept.join(roots, "thread_id", "left"), rows.withColumn("is_root", F.col("post_id") == F.col("root_post_id"))


def _edges(rows: DataFrame, label: str, a: Column, b: Column, post: str, ingest: datetime, prefix: str) -> DataFrame:
    edge_id = F.concat_ws(":", F.lit(f"edge:{prefix}"), *([a] if prefix == "authored" else []), F.col(post))
    return make_edges(rows, label, "L5", a, b, id=edge_id, references=F.array(F.col(post)), valid=(F.col("created"), None), ingest=(F.lit(ingest), None))


def assemble_forum(posts: DataFrame, comments: DataFrame, ingest: datetime) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a forum: forums, users, posts and comments; posted in, authored, replied to, belongs to, and topics of flairs."""
    forum = F.concat(F.lit("subreddit:"), F.col("forum"))
    users = first_seen(posts, comments)
    topics, topic_edges = assemble_topics(posts, "post_id", "flair", ingest)
    nodes = make_nodes(posts.select("forum").distinct(), "Subreddit", "L5", forum, F.struct(F.col("forum").alias("name")))
    nodes = nodes.unionByName(make_nodes(users, "User", "L5", F.col("user_id"), F.struct(F.col("author").alias("username"), F.col("first_seen").cast("string").alias("first_seen_utc"))))
    nodes = nodes.unionByName(make_nodes(posts, "Post", "L5", F.col("post_id"), F.struct("title", F.col("body").alias("selftext"), F.col("created").cast("string").alias("created_utc"), "score", "num_comments", F.col("forum").alias("subreddit"), "url", "over_18")))
    nodes = nodes.unionByName(make_nodes(comments, "Comment", "L5", F.col("comment_id"), F.struct("body", F.col("created").cast("string").alias("created_utc"), "score", F.col("forum").alias("subreddit"))))
    edges = _edges(posts, "POSTED_IN_FORUM", F.col("post_id"), forum, "post_id", ingest, "posted_in")
    for rows, own in ((posts, "post_id"), (comments, "comment_id")):
        edges = edges.unionByName(_edges(rows.where("user_id is not null"), "AUTHORED", F.col("user_id"), F.col(own), own, ingest, "authored"))
    edges = edges.unionByName(_edges(comments, "REPLIED_TO", F.col("comment_id"), F.col("parent_id"), "comment_id", ingest, "replied_to"))
    edges = edges.unionByName(_edges(comments, "BELONGS_TO_THREAD", F.col("comment_id"), F.col("post_id"), "comment_id", ingest, "belongs_to"))
    return nodes.unionByName(topics), edges.unionByName(topic_edges)


def assemble_board(threads: DataFrame, posts: DataFrame, ingest: datetime) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a threaded board; every post but a thread's first replies to the first."""
    category = F.concat(F.lit("sdn_category:"), F.col("category"))
    topics, topic_edges = assemble_topics(posts, "post_id", "category", ingest)
    named = threads.where("trim(category) <> ''").select("category").distinct()
    nodes = make_nodes(named, "SDNCategory", "L5", category, F.struct(F.col("category").alias("name")))
    nodes = nodes.unionByName(make_nodes(threads, "SDNThread", "L5", F.col("thread_id"), F.struct("title", "category", "url", "reply_count", "view_count", "root_post_id")))
    nodes = nodes.unionByName(make_nodes(first_seen(posts), "User", "L5", F.col("user_id"), F.struct(F.col("author").alias("username"), F.col("first_seen").cast("string").alias("first_seen_utc"))))
    nodes = nodes.unionByName(make_nodes(posts, "Post", "L5", F.col("post_id"), F.struct("body", F.col("created").cast("string").alias("created_utc"), "category", "thread_title", "page_number", F.col("is_root").alias("is_thread_root"))))
    edges = _edges(posts, "BELONGS_TO_THREAD", F.col("post_id"), F.col("thread_id"), "post_id", ingest, "belongs_to")
    edges = edges.unionByName(_edges(posts.where("trim(category) <> ''"), "POSTED_IN_FORUM", F.col("post_id"), category, "post_id", ingest, "posted_in"))
    edges = edges.unionByName(_edges(posts.where("not is_root"), "REPLIED_TO", F.col("post_id"), F.col("root_post_id"), "post_id", ingest, "replied_to"))
    edges = edges.unionByName(_edges(posts.where("user_id is not null"), "AUTHORED", F.col("user_id"), F.col("post_id"), "post_id", ingest, "authored"))
    return nodes.unionByName(topics), edges.unionByName(topic_edges)


def assemble_topics(rows: DataFrame, id_col: str, label_col: str, ingest: datetime) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a topic for each label, by its slug; the least label names it."""
    from tiergraph.functions.text import slug

    topic = F.concat(F.lit("topic:"), slug(F.col(label_col)))
    kept = rows.where(F.trim(label_col) != "").withColumn("__topic", topic)
    names = kept.groupBy("__topic").agg(F.min(label_col).alias("topic_label"))
    nodes = make_nodes(names, "Topic", "L5", F.col("__topic"), F.struct("topic_label"))
    return nodes, _edges(kept, "REFERENCES_TOPIC", F.col(id_col), F.col("__topic"), id_col, ingest, "references_topic")


def assemble_mentions(mentions: DataFrame, ingest: datetime) -> tuple[DataFrame, DataFrame]:
    """(edges, review rows) of mentions (id, entity_id, alias, score, needs_review, created)."""
    edges = make_edges(mentions, "MENTIONS_SCHOOL", "L5", F.col("id"), F.col("entity_id"), id=F.concat_ws(":", F.lit("edge:mentions"), "id", "entity_id"), references=F.array(F.col("id")), valid=(F.col("created"), None), ingest=(F.lit(ingest), None), confidence=F.col("score") / 100)
    return edges, mentions.where("needs_review").select(F.concat_ws(":", F.lit("mention"), "id", "entity_id").alias("item_id"), F.lit("alias_ambiguous").alias("kind"), "id", "entity_id", "alias", "score")
