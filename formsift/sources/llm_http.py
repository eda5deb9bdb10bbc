"""An LLM behind a local HTTP endpoint, as a plug-in of the pipeline.

The endpoint takes {"model", "prompt", "stream", "options"} and answers with
{"response"}. A call that fails gives no reply, so the other extractors' results
stay. Only counts are ever logged, never texts."""

from __future__ import annotations

import json
import os
import urllib.request
from dataclasses import dataclass, field

PROMPT = """You extract personal data from a document. Find only the person's
Name, Address and Date of Birth, and only where the document states them; leave out
other dates, places and people. Answer with JSON alone, in this form:
{"entities": [{"type": "Name", "value": "..."}]}
Use the types Name, Address and Date of Birth. If there are none, the list is empty.

Document:
"""


@dataclass
class HttpLlm:
    """Settings come from the environment of the task where they aren't given."""

    url: str = field(default_factory=lambda: os.environ.get("FORMSIFT_LLM_URL", "http://localhost:11434"))
    model: str = field(default_factory=lambda: os.environ.get("FORMSIFT_LLM_MODEL", "llama3.2:3b"))
    timeout: float = 120.0
    prompt: str = PROMPT

    def __call__(self, texts: list[str]) -> list[str | None]:
        return [self.ask(t) for t in texts]

    def ask(self, text: str | None) -> str | None:
        body = {"model": self.model, "prompt": self.prompt + (text or ""), "stream": False, "options": {"temperature": 0}}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.loads(reply.read()).get("response")
        except (OSError, ValueError):
            return None
