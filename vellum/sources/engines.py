"""Recognition engines for ``rasters.recognize``: a program that writes a table of words, and a worker that
answers a line for a line. Both read images from a pipe: nothing is written to a local disk."""

from __future__ import annotations

import base64
import json
import subprocess

from vellum.operators.rasters import bmp

Line = tuple[str, float, float, float, float, float]


def table_lines(table: str) -> list[Line]:
    """Lines of a word table (tab-separated, with a header): rows of level 4 open a line and give its box, rows
    of level 5 are its words; confidence is the words' mean by 100, of words of confidence 0 at least."""
    out: list[tuple[list[str], list[float], tuple[float, float, float, float]]] = []
    for row in table.splitlines()[1:]:
        c = row.split("\t")
        if len(c) < 12:
            continue
        if c[0] == "4":
            out.append(([], [], tuple(float(v) for v in c[6:10])))
        elif c[0] == "5" and out and c[11].strip() and float(c[10]) >= 0:
            out[-1][0].append(c[11].strip())
            out[-1][1].append(float(c[10]))
    return [(" ".join(w), *box, sum(p) / len(p) / 100) for w, p, box in out if w]


class TableProgram:
    """Runs ``command`` (say ["tesseract", "stdin", "stdout", "-l", "eng", "tsv"]) for each image."""

    def __init__(self, command: list[str], seconds: float = 120):
        self.command, self.seconds = command, seconds

    def __call__(self, width: int, height: int, components: int, samples: bytes) -> list[Line]:
        r = subprocess.run(self.command, input=bmp(width, height, components, samples), capture_output=True, timeout=self.seconds, check=True)
        return table_lines(r.stdout.decode("utf-8", "replace"))


class LineWorker:
    """Keeps one worker for each Python process: an image goes as a line of base64, and a line of JSON comes
    back, a list of {text, x, y, width, height, confidence}. A worker that dies is started again."""

    def __init__(self, command: list[str]):
        self.command = command
        self._process: subprocess.Popen | None = None

    def __getstate__(self) -> dict:
        return {"command": self.command, "_process": None}

    def __call__(self, width: int, height: int, components: int, samples: bytes) -> list[Line]:
        if self._process is None or self._process.poll() is not None:
            self._process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self._process.stdin.write(base64.b64encode(bmp(width, height, components, samples)) + b"\n")
        self._process.stdin.flush()
        answer = self._process.stdout.readline()
        if not answer:
            self._process = None
            raise RuntimeError("the worker has ended")
        return [(str(x["text"]), *(float(x.get(k, 0.0)) for k in ("x", "y", "width", "height")), float(x.get("confidence", 0.0))) for x in json.loads(answer)]
