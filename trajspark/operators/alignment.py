"""Messages of several topics brought to one timeline by nearest time, and frames made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.names import joint_group, match_names, normalized

#: Message types, words of topic names and categories. Fixed values.
IMAGE_TYPES = ("sensor_msgs/msg/Image", "sensor_msgs/msg/CompressedImage")
JOINT_TYPES = ("sensor_msgs/msg/JointState",)
STATE_WORDS, ACTION_WORDS = "state|status|feedback", "command|target|action|goal"
CAMERA_STRIP = ("image_raw", "compressed", "color", "image", "camera")
CATEGORY_RANK = {"camera": 0, "joint_state": 1, "other": 2}


def topic_names(topic: Column) -> Column:
    """Short camera name: path parts without the generic ones, after cam_. F12."""
    parts = F.split(F.trim(topic, F.lit("/")), "/")
    own = F.filter(parts, lambda p: ~F.lower(p).isin(*CAMERA_STRIP))
    name = F.when(F.size(own) > 0, F.array_join(own, "_")).otherwise(F.array_join(parts, "_"))
    return F.when(F.startswith(name, F.lit("cam")), name).otherwise(F.concat(F.lit("cam_"), name))


def state_name(topic: Column) -> Column:
    """F12."""
    return F.element_at(F.split(F.trim(topic, F.lit("/")), "/"), -1)


def topic_category(msg_type: Column) -> Column:
    return F.when(msg_type.isin(*IMAGE_TYPES), "camera").when(msg_type.isin(*JOINT_TYPES), "joint_state").otherwise("other")


def topic_role(topic: Column, msg_type: Column) -> Column:
    """F13."""
    is_state, is_action = F.lower(topic).rlike(STATE_WORDS), F.lower(topic).rlike(ACTION_WORDS)
    joint = F.when(is_state & is_action, "state+action").when(is_action, "action").otherwise("state")
    category = topic_category(msg_type)
    return F.when(category == "camera", "camera").when(category == "joint_state", joint).otherwise("skip")


def topic_catalog(messages: DataFrame) -> DataFrame:
    """A row per bag and topic: count, frequency over the bag's duration, category, role, joint names of the first
    message, and whether it is the base that is recommended: the slowest camera. A19, T4."""
    bag = messages.groupBy("bag").agg(((F.max("ts_ns") - F.min("ts_ns")) / 1e9).alias("seconds"))
    t = messages.groupBy("bag", "topic", "msg_type").agg(F.count(F.lit(1)).alias("n_messages"), F.min_by("names", F.struct("ts_ns", "seq")).alias("joint_names"))
    t = t.join(bag, "bag").withColumn("frequency", F.round(F.coalesce(F.try_divide("n_messages", "seconds"), F.lit(0.0)), 1))
    topic, kind = F.col("topic"), F.col("msg_type")
    t = t.withColumn("category", topic_category(kind)).withColumn("role", topic_role(topic, kind))
    name = F.when(F.col("category") == "camera", F.concat(F.lit("observation.images."), topic_names(topic))).when(F.col("category") == "joint_state", state_name(topic))
    t = t.withColumn("suggested_name", F.coalesce(name, F.replace(F.trim(topic, F.lit("/")), F.lit("/"), F.lit("."))))
    rank = F.create_map(*[F.lit(x) for p in CATEGORY_RANK.items() for x in p])[F.col("category")]
    t = t.withColumn("position", F.row_number().over(Window.partitionBy("bag").orderBy(rank, F.desc("frequency"), "topic")))
    slowest = F.min(F.when(F.col("category") == "camera", F.struct("frequency", "position"))).over(Window.partitionBy("bag"))
    return t.withColumn("recommended_base", F.coalesce(F.col("position") == slowest["position"], F.lit(False))).drop("seconds")


def build_anchors(messages: DataFrame, base: str, fps: float | None = None) -> DataFrame:
    """(bag, anchor, anchor_ns): the base topic's own times, or with ``fps`` an even grid over them whose end is open at
    last + greatest(1, step div 2). J2."""
    own = messages.where(F.col("topic") == base)
    if fps is None:
        times = own.select("bag", "ts_ns", "seq")
        return times.select("bag", (F.row_number().over(Window.partitionBy("bag").orderBy("ts_ns", "seq")) - 1).alias("anchor"), F.col("ts_ns").alias("anchor_ns"))
    step = max(1, round(1e9 / fps))
    span = own.groupBy("bag").agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"))
    grid = F.sequence(F.col("a"), F.col("b") + F.lit(max(1, step // 2) - 1), F.lit(step))
    return span.select("bag", F.posexplode(grid).alias("anchor", "anchor_ns"))


def align_nearest(messages: DataFrame, anchors: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """(bag, anchor, anchor_ns, topic, seq, ts_ns, delta_ns): for each anchor the message of each topic nearest in time,
    of two equally near the later; only topics with messages. Sorted by bag and topic, forth and back; payloads stay behind and are
    joined by (bag, topic, seq) where needed. J1."""
    m = messages.select("bag", "topic", "ts_ns", "seq")
    m = m.where(F.col("topic").isin(*topics)) if topics else m
    present = m.select("bag", "topic").distinct()
    wanted = anchors.join(present, "bag").select("bag", "topic", F.col("anchor_ns").alias("t"), F.lit(0).alias("kind"), "anchor", F.lit(None).cast("long").alias("seq"))
    there = m.select("bag", "topic", F.col("ts_ns").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("anchor"), "seq")
    both = wanted.withColumn("anchor", F.col("anchor").cast("int")).unionByName(there)
    # anchors stand before messages of their own time: what precedes is strictly earlier, what follows at or after. Both
    # frames begin at a partition's end, so each is a running value and no frame is scanned anew for a row
    group = Window.partitionBy("bag", "topic")
    up, down = group.orderBy("t", "kind", "seq"), group.orderBy(F.desc("t"), F.desc("kind"), F.desc("seq"))
    message = F.when(F.col("kind") == 1, F.struct("t", "seq"))
    before = F.last(message, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(message, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    near = both.withColumn("b", before).withColumn("a", after).where("kind = 0")
    early = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("t") - F.col("b.t") < F.col("a.t") - F.col("t")))
    pick = F.when(early, F.col("b")).otherwise(F.col("a"))
    out = near.select("bag", F.col("anchor").cast("long").alias("anchor"), F.col("t").alias("anchor_ns"), "topic", pick.alias("p"))
    return out.select("bag", "anchor", "anchor_ns", "topic", F.col("p.seq").alias("seq"), F.col("p.t").alias("ts_ns"), F.abs(F.col("p.t") - F.col("anchor_ns")).alias("delta_ns"))


def alignment_report(aligned: DataFrame, base: str, tolerance_ns: int, shown: int = 20) -> DataFrame:
    """By bag: frames, largest distance in milliseconds, frames beyond the tolerance and the first of them; the base
    topic does not count. A29."""
    delta = F.max(F.when(F.col("topic") != base, F.col("delta_ns")))
    frame = aligned.groupBy("bag", "anchor").agg(F.coalesce(delta, F.lit(0)).alias("delta"))
    frame = frame.withColumn("rank", F.row_number().over(Window.partitionBy("bag", F.col("delta") > tolerance_ns).orderBy("anchor")))
    beyond = F.col("delta") > tolerance_ns
    return frame.groupBy("bag").agg(
        F.count(F.lit(1)).alias("n_frames"), F.round(F.max("delta") / 1e6, 3).alias("max_delta_ms"), F.count_if(beyond).alias("n_beyond"),
        F.array_sort(F.collect_list(F.when(beyond & (F.col("rank") <= shown), F.col("anchor")))).alias("first_beyond"),
    )


def build_joint_layout(config: DataFrame) -> DataFrame:
    """Output axes of each role: (role, topic, source_index, name, output_index). ``config``: role, topic, topic_order,
    names, mapping (array of struct<source_index, target_index, name>), where no mapping means the source's own order.
    Entries without a source in range are dropped; explicit targets come first, then topic and mapping order. C10, T5."""
    default = F.transform(F.col("names"), lambda n, i: F.struct(i.alias("source_index"), F.lit(None).cast("int").alias("target_index"), n.alias("name")))
    entries = F.when(F.size("mapping") > 0, F.col("mapping")).otherwise(default)
    e = config.select("role", "topic", "topic_order", F.size("names").alias("width"), F.posexplode(entries).alias("entry_order", "m"))
    e = e.select("role", "topic", "topic_order", "width", "entry_order", "m.*").where("source_index >= 0 and source_index < width")
    order = Window.partitionBy("role").orderBy(F.col("target_index").isNull(), "target_index", "topic_order", "entry_order", "source_index")
    return e.withColumn("output_index", F.row_number().over(order) - 1).select("role", "topic", "source_index", "name", "output_index")


def validate_layout(config: DataFrame) -> DataFrame:
    """Problems of a layout: a target used twice in a role, or a role without mapped joints. C12."""
    m = config.select("role", F.explode_outer("mapping").alias("m"))
    twice = m.where("m.target_index is not null").groupBy("role", F.col("m.target_index").alias("target")).count().where("count > 1")
    twice = twice.select("role", F.format_string("target %d is used %d times", "target", "count").alias("problem"))
    none = m.groupBy("role").agg(F.count("m").alias("n")).where("n = 0").select("role", F.lit("no joint is mapped").alias("problem"))
    return twice.union(none)


def assemble_vectors(aligned: DataFrame, messages: DataFrame, layout: DataFrame) -> DataFrame:
    """(bag, anchor, role, vector): aligned positions in the layout's order; an index beyond a message's positions fails.
    C11."""
    p = aligned.join(messages.select("bag", "topic", "seq", "positions"), ["bag", "topic", "seq"])
    placed = p.join(layout, "topic").withColumn("value", F.element_at("positions", F.col("source_index") + 1))
    values = F.transform(F.array_sort(F.collect_list(F.struct("output_index", "value"))), lambda s: s["value"])
    return placed.groupBy("bag", "anchor", "role").agg(values.alias("vector"))


def propagate_layout(topics: DataFrame, assigned: DataFrame) -> DataFrame:
    """Assignments carried to topics of the same ordered names in roles that don't overlap: (bag, topic, role, from_topic).
    ``topics``: bag, topic, role, names; ``assigned``: bag, topic. C14."""
    sign = F.array_join(F.transform("names", lambda n: F.lower(F.trim(n))), "|")
    t = topics.select("bag", "topic", "role", sign.alias("signature"))
    done = t.join(assigned.select("bag", "topic"), ["bag", "topic"]).select("bag", F.col("topic").alias("from_topic"), F.col("role").alias("from_role"), "signature")
    met = t.join(done, ["bag", "signature"]).where((F.col("topic") != F.col("from_topic")) & ~F.arrays_overlap(F.split("role", r"\+"), F.split("from_role", r"\+")))
    return met.groupBy("bag", "topic", "role").agg(F.min("from_topic").alias("from_topic"))


def assign_layout(topics: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets of every joint of every topic: (bag, topic, source_index, source_name, target_name, from_topic), null where
    there is none. Each topic's names are matched with its bag's targets (see ``names``, the topic gives side and part);
    topics of the same ordered names and groups whose roles don't overlap share what the last of them got. ``topics``: bag,
    topic, topic_order, role, names; ``targets``: bag, target_index, name. C14, J10."""
    joints = topics.select("bag", "topic", "topic_order", "role", F.posexplode("names").alias("source_index", "source_name"))
    own = F.to_json(F.struct("bag", "topic"))
    sources = joints.select(own.alias("dataset_id"), F.col("source_index").alias("name_index"), F.col("source_name").alias("name"), F.col("topic").alias("context"))
    wanted = topics.select("bag", "topic").join(targets, "bag").select(own.alias("dataset_id"), F.col("target_index").alias("name_index"), "name")
    found = match_names(sources, wanted, grouped=True).select(F.col("dataset_id").alias("own"), "source_index", "target_name")
    mapped = joints.withColumn("own", own).join(found, ["own", "source_index"], "left").drop("own")
    sign = F.array_join(F.transform("names", lambda n: F.concat(normalized(n), F.lit("@"), joint_group(n, F.col("topic")))), "|")
    t = topics.select("bag", "topic", "role", sign.alias("signature"))
    other = t.select("bag", F.col("topic").alias("from_topic"), F.col("role").alias("from_role"), "signature")
    apart = (F.col("role") != "") & (F.col("from_role") != "") & ~F.arrays_overlap(F.split("role", r"\+"), F.split("from_role", r"\+"))
    linked = t.join(other, ["bag", "signature"]).where((F.col("topic") == F.col("from_topic")) | apart).select("bag", "topic", "from_topic")
    given = mapped.select("bag", F.col("topic").alias("from_topic"), "topic_order", "source_index", "source_name", "target_name")
    last = linked.join(given, ["bag", "from_topic"]).groupBy("bag", "topic", "source_index", "source_name")
    return last.agg(F.max(F.struct("topic_order", "from_topic", "target_name")).alias("m")).select("bag", "topic", "source_index", "source_name", "m.target_name", "m.from_topic")


def messages_to_frames(messages: DataFrame, base: str, layout: DataFrame, fps: float, rebuild: bool = False, tolerance_ns: int = 10_000_000) -> DataFrame:
    """Frames of all bags in one plan: anchors, nearest messages, vectors by role; times are pos / fps, the task is 0.
    Frame numbers run from 0 in each bag. M1."""
    anchors = build_anchors(messages, base, fps if rebuild else None)
    aligned = align_nearest(messages, anchors)
    vectors = assemble_vectors(aligned, messages, layout)
    wide = vectors.groupBy("bag", "anchor").pivot("role", ["state", "action"]).agg(F.first("vector"))
    n = F.row_number().over(Window.partitionBy("bag").orderBy("anchor")) - 1
    return wide.select(
        F.lit("messages").alias("dataset_id"), "bag", n.cast("long").alias("pos"), n.cast("long").alias("frame_index"), (n / fps).alias("timestamp"),
        F.lit(0).cast("long").alias("task_index"), "state", "action",
    )
