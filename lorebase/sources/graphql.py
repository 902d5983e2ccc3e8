"""Content trees from a GraphQL endpoint, or from its recorded answers.

The HTTP call is a function that the caller supplies; this module holds the queries,
the log-in steps, the retry rule and the error rule. Answers become a table of JSON
bodies, which ``operators.tree.read_answers`` flattens.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.models import with_retries

# The wire queries.
_PROFILE = "profile { displayName description url }"
_CALLOUTS = f"""callouts {{
  id
  framing {{ {_PROFILE} }}
  contributions {{
    post {{ id {_PROFILE} }}
    whiteboard {{ id profile {{ displayName url }} content }}
    link {{ id {_PROFILE} uri }}
  }}
}}"""


def space_selection(levels: int) -> str:
    below = f" subspaces {{ {space_selection(levels - 1)} }}" if levels > 1 else ""
    return f"id {_PROFILE} collaboration {{ calloutsSet {{ {_CALLOUTS} }} }}{below}"


SPACE_QUERY = f"query SpaceTree($spaceId: UUID!) {{ lookup {{ space(ID: $spaceId) {{ {space_selection(3)} }} }} }}"
KNOWLEDGE_BASE_QUERY = (
    f"query KnowledgeBaseTree($kbId: UUID!) {{ lookup {{ knowledgeBase(ID: $kbId) {{ id {_PROFILE} calloutsSet {{ {_CALLOUTS} }} }} }} }}"
)

Post = Callable[[str, dict, dict], dict]  # address, headers, JSON body -> JSON answer
Get = Callable[[str], dict]


@dataclass
class TreeClient:
    endpoint: str
    login_address: str
    email: str
    password: str
    post: Post
    get: Get
    sleep: Callable[[float], None] = time.sleep
    token: str | None = field(default=None, repr=False)

    def authenticate(self) -> str:
        flow = self.get(f"{self.login_address.rstrip('/')}/self-service/login/api")
        answer = self.post(
            flow["ui"]["action"], {}, {"method": "password", "identifier": self.email, "password": self.password}
        )
        self.token = answer["session_token"]
        return self.token

    def query(self, text: str, variables: dict | None = None) -> dict:
        """Data of the answer; reported errors raise. Three attempts with growing pauses."""
        token = self.token or self.authenticate()

        def call() -> dict:
            answer = self.post(
                self.endpoint, {"Authorization": f"Bearer {token}", "Content-Type": "application/json"}, {"query": text, "variables": variables or {}}
            )
            if "errors" in answer:
                raise RuntimeError(f"GraphQL errors: {answer['errors']}")
            return answer.get("data", {})

        return with_retries(call, fixed.RETRY_ATTEMPTS, fixed.RETRY_BASE_SECONDS, self.sleep, final=())

    def body(self, body_id: str, bok_type: str, flat_type: str = fixed.FLAT_TREE_TYPE) -> dict:
        if bok_type == flat_type:
            return self.query(KNOWLEDGE_BASE_QUERY, {"kbId": body_id})
        return self.query(SPACE_QUERY, {"spaceId": body_id})


def fetch(spark: SparkSession, client: TreeClient, requests: list[tuple[str, str, str]], flat_type: str = fixed.FLAT_TREE_TYPE) -> DataFrame:
    """(collection, bok_type, body) of (collection, body id, type) requests: one answer per request."""
    rows = [(collection, kind, json.dumps(client.body(body_id, kind, flat_type))) for collection, body_id, kind in requests]
    return spark.createDataFrame(rows, "collection string, bok_type string, body string")


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded answers: JSON lines of (collection, bok_type, data)."""
    lines = spark.read.text(folder).select(F.col("value"))
    return lines.select(
        F.get_json_object("value", "$.collection").alias("collection"), F.get_json_object("value", "$.bok_type").alias("bok_type"),
        F.get_json_object("value", "$.data").alias("body"),
    )
