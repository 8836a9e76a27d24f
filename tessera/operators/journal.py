"""A journal of finished answers: one folder per partition, one file per task attempt."""

from __future__ import annotations

import json
import re
import threading
import uuid

from pyarrow import fs as pafs


class Journal:
    """Answers by entry.  Each is written and flushed as one line when it comes,
    so it outlives the attempt that got it; a line cut off by a crash is left out
    when the folder is read.  ``folder`` is a path or URI that ``pyarrow.fs`` opens
    and whose files keep what was flushed (local and network folders, HDFS); an
    object store keeps a file only when it is closed.
    """

    def __init__(self, folder: str):
        self._fs, self._folder = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))
        self._lock, self._out = threading.Lock(), None
        self.answers: dict[str, str | None] = {}
        self._fs.create_dir(self._folder, recursive=True)
        for found in self._fs.get_file_info(pafs.FileSelector(self._folder)):
            with self._fs.open_input_stream(found.path) as lines:
                whole = lines.read().split(b"\n")[:-1]  # after the last line end: nothing, or a line cut off
            self.answers.update(map(json.loads, whole))

    def add(self, entry: str, answer: str | None) -> None:
        line = json.dumps([entry, answer]).encode() + b"\n"
        with self._lock:
            if self._out is None:
                self._out = self._fs.open_output_stream(f"{self._folder}/{uuid.uuid4().hex}.jsonl")
            self._out.write(line)
            self._out.flush()
            self.answers[entry] = answer

    def __enter__(self) -> Journal:
        return self

    def __exit__(self, *failure) -> None:
        if self._out is not None:
            self._out.close()
