"""External documents as they were collected once: bodies pinned by digest, read in pages, never fetched again."""

from __future__ import annotations

import hashlib
import json
import os

from ..errors import QueryLookupError, QueryValidationError, Refusal

MOST_CHARS = 32_768


class Snapshot:
    """A folder with ``snapshot.json`` and ``bodies/``; every body is checked on load and on each read."""

    def __init__(self, folder: str) -> None:
        self.folder = os.path.realpath(folder)
        with open(os.path.join(self.folder, "snapshot.json"), "rb") as f:
            raw = f.read()
        self.sha256 = hashlib.sha256(raw).hexdigest()
        self.records = {r["id"]: r for r in json.loads(raw)["records"]}
        for r in self.records:
            self._body(r)

    def _record(self, record_id: str) -> dict:
        if record_id not in self.records:
            raise QueryLookupError(f"no record {record_id!r}; records: {sorted(self.records)}")
        return self.records[record_id]

    def _body(self, record_id: str) -> bytes | None:
        r = self._record(record_id)
        if not r.get("body_path"):
            return None
        path = os.path.realpath(os.path.join(self.folder, r["body_path"]))
        if os.path.dirname(path) != os.path.join(self.folder, "bodies"):
            raise Refusal(f"record {record_id!r} points outside bodies/")
        with open(path, "rb") as f:
            body = f.read()
        if hashlib.sha256(body).hexdigest() != r["body_sha256"].removeprefix("sha256:"):
            raise Refusal(f"record {record_id!r}: the body no longer matches its digest")
        return body

    def list(self) -> list[dict]:
        return [{k: v for k, v in r.items() if k != "body_path"} for r in self.records.values()]

    def read(self, record_id: str, offset: int = 0, limit: int = 8192) -> dict[str, object]:
        if offset < 0 or not 0 < limit <= MOST_CHARS:
            raise QueryValidationError(f"offset is 0 or more and limit lies within 1..{MOST_CHARS}")
        body = self._body(record_id)
        if body is None:
            return {"id": record_id, "text": None, "detail": "no body was received"}
        try:
            text = body.decode("utf-8")
        except UnicodeDecodeError:
            return {"id": record_id, "text": None, "detail": "the body is not UTF-8 text"}
        return {"id": record_id, "offset": offset, "total_chars": len(text), "text": text[offset : offset + limit]}
