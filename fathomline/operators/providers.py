"""A re-ranking provider behind an HTTP endpoint of the common chat-completions form."""

from __future__ import annotations

import json
import os
import re
from urllib import request as http

from .rerank import prompt


class ChatProvider:
    """Asks ``base_url``/chat/completions for a JSON object with a ranking, at temperature 0.

    The key is read in the worker from the environment variable ``key_variable``; it is never part of a plan.
    """

    def __init__(self, model: str, base_url: str, key_variable: str, timeout: int = 120, version: str = "v1"):
        self.model, self.base_url, self.key_variable, self.timeout, self.version = model, base_url.rstrip("/"), key_variable, timeout, version

    @property
    def name(self) -> str:
        return f"chat:{self.base_url}:{self.model}"

    def __call__(self, request: dict) -> list[dict]:
        key = os.environ.get(self.key_variable)
        if not key:
            raise RuntimeError(f"{self.key_variable} is not set")
        body = {
            "model": self.model, "temperature": 0, "response_format": {"type": "json_object"},
            "messages": [{"role": "system", "content": prompt(self.version)}, {"role": "user", "content": json.dumps(request, ensure_ascii=False)}],
        }
        asked = http.Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, method="POST")
        with http.urlopen(asked, timeout=self.timeout) as reply:
            content = json.loads(reply.read())["choices"][0]["message"]["content"]
        found = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", content.strip()))
        if not isinstance(found, dict) or not isinstance(found.get("ranking"), list):
            raise ValueError("the reply has no ranking")
        return [{"candidate_id": str(r.get("candidate_id")), "score": None if r.get("score") is None else str(r["score"])} for r in found["ranking"] if isinstance(r, dict)]
