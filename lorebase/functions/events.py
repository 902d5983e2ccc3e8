"""Inbound and outbound events: wire schemas, routing, envelopes, retry decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.text import let

QUERY_SCHEMA = (
    "engine string, operation string, userID string, message string, bodyOfKnowledgeID string, contextID string, "
    "history array<struct<content: string, role: string>>, externalMetadata struct<threadId: string>, "
    "externalConfig struct<apiKey: string, assistantId: string, model: string>, displayName string, "
    "description string, personaID string, language string, "
    "resultHandler struct<action: string, roomDetails: struct<roomID: string, actorID: string, threadID: string, "
    "vcInteractionID: string>>, prompt array<string>, promptGraph string"
)
WEBSITE_SCHEMA = (
    "baseUrl string, type string, purpose string, personaId string, summarizationModel string"
)
TREE_SCHEMA = (
    "bodyOfKnowledgeId string, type string, purpose string, personaId string"
)
SOURCE_SCHEMA = (
    "chunkIndex int, embeddingType string, documentId string, source string, title string, type string, "
    "score double, uri string"
)
RESPONSE_SCHEMA = (
    "result string, humanLanguage string, resultLanguage string, knowledgeLanguage string, originalResult string, "
    "sources array<struct<chunkIndex: int, embeddingType: string, documentId: string, source: string, title: string, "
    "type: string, score: double, uri: string>>, threadId string"
)
TREE, WEBSITE, QUERY, ERROR = "tree-ingest", "website-ingest", "query", "error"

_DEFAULTS = {"operation": "query", "contextID": "", "displayName": "", "description": "", "personaID": "", "language": "EN"}

# Required text fields: wire name, plain name.
_TREE_FIELDS = (("bodyOfKnowledgeId", "body_of_knowledge_id"), ("type", "type"), ("purpose", "purpose"), ("personaId", "persona_id"))
_WEBSITE_FIELDS = (("baseUrl", "base_url"), ("type", "type"), ("purpose", "purpose"), ("personaId", "persona_id"))
_QUERY_FIELDS = (("engine", "engine"), ("userID", "user_id"), ("message", "message"))


def _is_text(body: Column, path: str) -> Column:
    value = F.try_variant_get(body, path, "variant")
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _complete(body: Column, root: str, fields: tuple[tuple[str, str], ...]) -> Column:
    checks = [_is_text(body, f"{root}.{wire}") | _is_text(body, f"{root}.{plain}") for wire, plain in fields]
    result = checks[0]
    for check in checks[1:]:
        result = result & check
    return result


def route(body: Column, plugin_type: Column) -> Column:
    """Event kind of a JSON message; the worker's own type decides first."""
    return let(F.try_parse_json(body), lambda parsed: _kind(parsed, plugin_type))


def _kind(parsed: Column, plugin_type: Column) -> Column:
    event_type = F.try_variant_get(parsed, "$.eventType", "string")
    has_input = F.try_variant_get(parsed, "$.input", "variant").isNotNull()
    return (
        F.when(parsed.isNull(), ERROR)
        .when(plugin_type == "ingest-space", F.when(_complete(parsed, "$", _TREE_FIELDS), TREE).otherwise(ERROR))
        .when(F.coalesce(event_type == "IngestWebsite", F.lit(False)),
              F.when(_complete(parsed, "$", _WEBSITE_FIELDS), WEBSITE).otherwise(ERROR))
        .when(has_input, F.when(_complete(parsed, "$.input", _QUERY_FIELDS), QUERY).otherwise(ERROR))
        .otherwise(ERROR)
    )


def is_ingest(kind: Column) -> Column:
    """Ingest events are acknowledged before the work, questions after it."""
    return kind.isin(TREE, WEBSITE)


def parse_query(body: Column) -> Column:
    """The question event of a message with the documented defaults filled in."""
    names = [part.split()[0] for part in _top_level(QUERY_SCHEMA)]

    def filled(e: Column) -> Column:
        return F.struct(*[F.coalesce(e[n], F.lit(_DEFAULTS[n])).alias(n) if n in _DEFAULTS else e[n].alias(n) for n in names])

    return let(F.from_json(F.get_json_object(body, "$.input"), QUERY_SCHEMA), filled)


def _top_level(ddl: str) -> list[str]:
    """Field definitions of a schema text, split at the commas outside of angle brackets."""
    parts, depth = [""], 0
    for char in ddl:
        depth += {"<": 1, ">": -1}.get(char, 0)
        if char == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    return parts


def envelope(response: Column, kind: Column, original: Column) -> Column:
    """Published JSON: the response, and for questions the original event."""
    with_original = F.to_json(F.struct(response.alias("response"), original.alias("original")))
    return F.when(kind == QUERY, with_original).otherwise(F.to_json(F.struct(response.alias("response"))))


def failed_delivery(retry_count: Column, parsed: Column, max_deliveries: int = fixed.MAX_DELIVERIES) -> Column:
    """What happens to a message whose handling failed: retry quietly, then report once or drop."""
    return F.when(retry_count < max_deliveries - 1, "retry").when(parsed, "publish_error").otherwise("drop")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def backoff_seconds(attempt: Column) -> Column:
    return fixed.RETRY_BASE_SECONDS * F.pow(F.lit(2.0), attempt)
