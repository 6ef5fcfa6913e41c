"""Start messages to requests, replies to roles and query lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import schemas
from dossier.functions import fixed_values as fixed
from dossier.functions.text import literal_table


def _values(text) -> F.Column:
    """Values of a text read as the inside of a JSON array; null if it is not one."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")


def _parses(text) -> F.Column:
    """Whether a text is one JSON value and nothing else.

    The parser stops after a value, so text behind it goes unseen; but inside brackets and
    inside braces it must be closed by the right one of them."""
    braced = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    whole = (F.size(_values(text)) == 1) & braced.isNotNull()
    return F.coalesce(whole, F.lit(False))


STRICT = {"allowSingleQuotes": "false"}


def ingest(messages: DataFrame) -> DataFrame:
    """Start messages only, parsed.  Malformed JSON stays as a row with an error."""
    body = F.expr(f"substring(message, {fixed.START_CUT + 1})")
    others = [c for c in messages.columns if c != "message"]
    return (
        messages.where(F.col("message").startswith(fixed.START_WORD))
        .select(
            *others,
            F.from_json(body, schemas.REQUEST_JSON, STRICT).alias("_request"),
            F.when(~_parses(body), "malformed request").alias("error"),
        )
        .select(*others, "_request.task", "_request.report_type", "_request.agent", "error")
    )


def validate(requests: DataFrame) -> DataFrame:
    """All requests with ``accepted`` and, where rejected, the reason."""
    present = [F.coalesce(c, F.lit("")) != "" for c in ("task", "report_type", "agent")]
    complete = present[0] & present[1] & present[2]
    return requests.withColumn(
        "error", F.coalesce("error", F.when(~complete, fixed.NOT_ENOUGH_PARAMETERS))
    ).withColumn("accepted", F.col("error").isNull())


def role_table(spark) -> DataFrame:
    return literal_table(spark, ["agent", "role_prompt"], list(fixed.ROLE_PROMPTS.items()))


def resolve_role(requests: DataFrame) -> DataFrame:
    """Role prompt of each request: an explicit one, else the agent's, else a fixed text.

    The broadcast side is the fixed table of six roles."""
    roles = F.broadcast(role_table(requests.sparkSession))
    explicit = F.when(F.col("agent_role_prompt") != "", F.col("agent_role_prompt"))
    return (
        requests.join(roles, "agent", "left")
        .withColumn(
            "role_prompt", F.coalesce(explicit, "role_prompt", F.lit(fixed.NO_SUCH_AGENT))
        )
        .drop("agent_role_prompt")
    )


def auto_role(replies: DataFrame) -> DataFrame:
    """Agent and role prompt from a model's reply.

    A failed call or a reply that is not JSON gives the default agent and its prompt.
    A reply that parses but lacks a field is left with that field empty."""
    usable = _parses(F.col("reply"))
    role = F.from_json("reply", schemas.ROLE_JSON, STRICT)
    others = [c for c in replies.columns if c != "reply"]
    return replies.select(*others, usable.alias("_ok"), role.alias("_role")).select(
        *others,
        F.when(F.col("_ok"), F.col("_role.agent")).otherwise(fixed.DEFAULT_AGENT).alias("agent"),
        F.when(F.col("_ok"), F.col("_role.agent_role_prompt"))
        .otherwise(fixed.ROLE_PROMPTS[fixed.DEFAULT_AGENT])
        .alias("agent_role_prompt"),
    )


def settle_agents(requests: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Requests for the automatic agent take agent and role prompt from the model's reply;
    the others keep theirs and have no explicit prompt.  A missing reply counts as a
    failed call.  There is one reply per request at most."""
    asked = requests.withColumnRenamed("agent", "_asked").join(
        replies.select(*keys, "reply"), keys, "left"
    )
    auto = F.coalesce(F.col("_asked") == fixed.AUTO_AGENT, F.lit(False))
    return (
        auto_role(asked)
        .withColumn("agent", F.when(auto, F.col("agent")).otherwise(F.col("_asked")))
        .withColumn("agent_role_prompt", F.when(auto, F.col("agent_role_prompt")))
        .drop("_asked")
    )


def list_fanout(replies: DataFrame, item: str, limit: int | None = None) -> DataFrame:
    """One row per string of a JSON-array reply: ``{item}_idx`` and ``item``.

    The number of strings a prompt asks for is not enforced unless ``limit`` is given.
    A reply that is not a JSON array of strings gives one row with an error instead."""
    others = [c for c in replies.columns if c != "reply"]
    values = F.try_variant_get(F.try_parse_json("reply"), "$", "array<variant>")
    texts = F.forall(values, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    parsed = F.when(
        F.col("reply").rlike(r"^\s*\[") & _parses(F.col("reply")) & texts,
        F.from_json("reply", schemas.STRING_LIST_JSON, STRICT),
    )
    kept = parsed if limit is None else F.slice(parsed, 1, limit)
    listed = replies.select(*others, kept.alias("_items"))
    # An empty list fans out to nothing; a null one is an error row.
    error = F.when(F.col("_items").isNull(), "malformed reply")
    return (
        listed.select(*others, "_items", error.alias("error"))
        .select(*others, "error", F.posexplode_outer("_items").alias("_pos", item))
        .where(F.col("_pos").isNotNull() | F.col("error").isNotNull())
        .select(*others, F.col("_pos").cast("bigint").alias(f"{item}_idx"), item, "error")
    )
