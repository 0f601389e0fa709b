"""Job logs as a streaming source that can be read again from the start of a log, after a lost connection or a restart, without repeating a line.

``spark.dataSource.register(JobLogs)``, then ``spark.readStream.format("job_logs").load(folder)``: one file a job, its name without ending the job's
id. Offsets are the bytes of whole lines read of each job. A log that is shorter than its offset (a reconnect that has not caught up) gives
nothing until it has grown past it; the option ``marks`` names a file that keeps the offsets, so that this holds across restarts too. A line is
given once its end has come.
"""

from __future__ import annotations

import json
import time

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes looked at for a line's end, from a log's end backwards, at a time.
BLOCK = 1 << 16


def _retried(call, tries: int, wait: float):
    """``call()``, again after a lost connection; the last failure is the caller's."""
    for k in range(tries):
        try:
            return call()
        except (ConnectionError, TimeoutError, OSError):
            if k == tries - 1:
                raise
            time.sleep(wait)


def _filesystem(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)


class _Part(InputPartition):
    def __init__(self, job: str, file: str, start: int, end: int):
        self.job, self.file, self.start, self.end = job, file, start, end


class JobLogs(DataSource):
    """(job_id string, at long, line string): ``at`` is the byte at which a line begins. Options: marks, tries (5), wait (1 second between tries)."""

    @classmethod
    def name(cls) -> str:
        return "job_logs"

    def schema(self) -> str:
        return "job_id string, at long, line string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.tries, self.wait = options["path"], int(options.get("tries", 5)), float(options.get("wait", 1))
        self.marks, self.known = options.get("marks"), None

    def initialOffset(self) -> dict:
        return {}

    def _recall(self) -> dict:
        """Offsets known so far; those of the marks' file at first."""
        if self.known is None:
            self.known = {}
            if self.marks:
                system, file = _filesystem(self.marks)
                try:
                    with system.open_input_file(file) as f:
                        self.known = json.loads(f.read())
                except FileNotFoundError:
                    pass
        return self.known

    def _logs(self) -> dict[str, tuple[str, int]]:
        import pyarrow.fs as fs

        system, root = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {f.base_name.rsplit(".", 1)[0]: (f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}

    def _whole(self, file: str, start: int, size: int) -> int:
        """Where the last whole line ends, ``start`` if there is none after it."""
        system, _ = _filesystem(self.path)
        with system.open_input_file(file) as f:
            while size > start:
                a = max(start, size - BLOCK)
                f.seek(a)
                at = f.read(size - a).rfind(b"\n")
                if at >= 0:
                    return a + at + 1
                size = a
        return start

    def latestOffset(self) -> dict:
        known, logs = self._recall(), _retried(self._logs, self.tries, self.wait)
        for job, (file, size) in logs.items():
            start = known.get(job, 0)
            if size > start:
                known[job] = _retried(lambda f=file, a=start, n=size: self._whole(f, a, n), self.tries, self.wait)
        return dict(known)

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        known = self._recall()
        known.update({job: max(int(n), known.get(job, 0)) for job, n in end.items()})
        logs = _retried(self._logs, self.tries, self.wait)
        return [_Part(job, logs[job][0], int(start.get(job, 0)), int(n)) for job, n in sorted(end.items()) if n > start.get(job, 0) and job in logs]

    def read(self, part: _Part):
        def fetch() -> bytes:
            system, _ = _filesystem(self.path)
            with system.open_input_file(part.file) as f:
                f.seek(part.start)
                return f.read(part.end - part.start)

        at = part.start
        for line in _retried(fetch, self.tries, self.wait).split(b"\n")[:-1]:
            yield part.job, at, line.decode("utf-8", "replace").rstrip("\r")
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        if self.marks:
            system, file = _filesystem(self.marks)
            with system.open_output_stream(file) as f:
                f.write(json.dumps({job: max(int(n), self._recall().get(job, 0)) for job, n in end.items()}).encode())
