"""Replies of user functions that outlive the task, and the run, that asked for them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from ..sources.files import opened


class Replies:
    """One small file for each successful call, named by a hash of its request, in a folder that all executors reach.

    A reply is written before the next call begins, under a temporary name first. A task that runs
    again, or a later run with the same folder, finds the replies there and only calls for the
    rest. Failed calls leave nothing. Two tasks with the same request at once may both call;
    either reply is whole.
    """

    def __init__(self, folder: str, kind: str):
        self.system, self.root = opened(folder)
        self.kind = kind

    def get(self, request: Any, call: Callable[[], Any]) -> Any:
        """The stored reply to a request (plain data), or that of the call, as JSON gives it back."""
        from pyarrow import fs

        body = json.dumps([self.kind, request], ensure_ascii=False, sort_keys=True, default=str)
        key = hashlib.sha256(body.encode()).hexdigest()
        # 65,536 folders, so that none gets too many files.
        folder = f"{self.root}/{key[:2]}/{key[2:4]}"
        path = f"{folder}/{key}.json"
        if self.system.get_file_info(path).type == fs.FileType.File:
            with self.system.open_input_stream(path) as file:
                return json.loads(file.read())
        reply = call()
        self.system.create_dir(folder)
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with self.system.open_output_stream(temporary) as file:
            file.write(json.dumps(reply, ensure_ascii=False).encode())
        self.system.move(temporary, path)
        return reply
