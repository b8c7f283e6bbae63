"""Bounded processes: a time limit, a limit on each output stream while it is read, and no descendants left behind."""

from __future__ import annotations

import os
import signal
import subprocess
import threading
import time
from dataclasses import dataclass

#: Seconds, and bytes of a stream; the environment overrides them.
TIMEOUT, LIMIT = 120.0, 64 << 20
TIMEOUT_NAME, LIMIT_NAME = "LINEFACTS_PROCESS_SECONDS", "LINEFACTS_PROCESS_BYTES"


class ProcessError(RuntimeError):
    """A process that can't start, takes too long, says too much, or was interrupted."""


@dataclass(frozen=True)
class Done:
    stdout: bytes
    stderr: bytes
    code: int

    @property
    def complaint(self) -> str:
        return self.stderr.decode(errors="replace").strip()


def _limit(name: str, default: float) -> float:
    """A limit from the environment; anything but a positive number raises."""
    text = os.environ.get(name)
    if text is None:
        return default
    try:
        value = float(text)
    except ValueError:
        value = 0
    if value <= 0:
        raise ProcessError(f"{name} must be a positive number, not {text!r}")
    return value


def run(command: list[str], purpose: str, timeout: float | None = None, limit: int | None = None, cwd: str | None = None) -> Done:
    """Runs a command in a process group of its own; the group is killed when the command ends, for whatever reason.

    SIGINT and SIGTERM that reach this process meanwhile are handed to the
    group, and then take their usual course here.
    """
    timeout = _limit(TIMEOUT_NAME, TIMEOUT) if timeout is None else timeout
    limit = int(_limit(LIMIT_NAME, LIMIT)) if limit is None else limit
    try:
        p = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, stdin=subprocess.DEVNULL, start_new_session=True, cwd=cwd)
    except OSError as e:
        raise ProcessError(f"{purpose}: {e}") from e
    held, over, told = ([], []), threading.Event(), []

    def kill(sig: int = signal.SIGKILL) -> None:
        try:
            os.killpg(p.pid, sig)
        except (ProcessLookupError, PermissionError):
            pass

    def read(stream, into: list[bytes]) -> None:
        size = 0
        while part := stream.read1(1 << 16):
            size += len(part)
            if size > limit:
                over.set()
                kill()
                return
            into.append(part)

    def passed_on(sig, _):
        told.append(sig)
        kill(sig)

    main = threading.current_thread() is threading.main_thread()
    before = {s: signal.signal(s, passed_on) for s in (signal.SIGINT, signal.SIGTERM)} if main else {}
    readers = [threading.Thread(target=read, args=x, daemon=True) for x in zip((p.stdout, p.stderr), held)]
    late = False
    try:
        for r in readers:
            r.start()
        end = time.monotonic() + timeout
        while p.poll() is None and not told:
            if time.monotonic() > end:
                late = True
                break
            time.sleep(0.005)
    finally:
        kill()  # descendants too; they may hold the streams open
        p.wait()
        for r in readers:
            r.join(5)
        p.stdout.close()
        p.stderr.close()
        for s, f in before.items():
            signal.signal(s, f)
    if told:
        if callable(before[told[0]]):
            before[told[0]](told[0], None)
        raise ProcessError(f"{purpose}: interrupted by signal {told[0]}")
    if over.is_set():
        raise ProcessError(f"{purpose}: more than {limit} bytes of output")
    if late:
        raise ProcessError(f"{purpose}: no end after {timeout:g} s")
    return Done(b"".join(held[0]), b"".join(held[1]), p.returncode)


def text_of(done: Done, purpose: str) -> str:
    """The output of a process that ended well."""
    if done.code:
        raise ProcessError(f"{purpose}: exit code {done.code}: {done.complaint[-500:]}")
    try:
        return done.stdout.decode()
    except UnicodeDecodeError as e:
        raise ProcessError(f"{purpose}: output isn't UTF-8") from e
