"""Runs in a fresh interpreter of its own, with the standard library alone: forks a limited and guarded child for each
program that it is sent, and tells what became of it.

A request is a line of JSON (bytes, seconds, memory_mb) and the program's bytes; an answer is a line of JSON
(result). A child says itself that its program came to its end, so ending the process early passes nothing.
"""

import json
import os
import resource
import select
import shutil
import signal
import sys
import tempfile
import time

FILE_BYTES, PROCESSES, OPEN_FILES = 1 << 20, 32, 64
# What a program cannot call or import.
NO_BUILTINS = ["exit", "quit", "open", "input"]
NO_OS_BEGINNINGS = ["exec", "spawn", "posix_spawn"]
NO_OS = [
    "_exit", "chflags", "chmod", "chown", "fchmod", "fchown", "fork", "forkpty", "getpid", "getppid", "kill", "killpg", "lchflags", "lchmod", "lchown", "link", "listdir", "open", "popen", "remove", "rename",
    "rmdir", "symlink", "system", "unlink",
]
NO_SHUTIL = ["copy", "copy2", "move", "rmtree"]
NO_MODULES = [
    "aiohttp", "ctypes", "faulthandler", "ftplib", "http", "httpx", "ipdb", "joblib", "multiprocessing", "psutil", "requests", "resource", "socket", "ssl", "subprocess", "tkinter", "urllib",
]


def limit(seconds, memory_mb):
    cpu = int(seconds) + 1
    wanted = {resource.RLIMIT_CPU: cpu, resource.RLIMIT_FSIZE: FILE_BYTES, resource.RLIMIT_CORE: 0, resource.RLIMIT_NOFILE: OPEN_FILES, resource.RLIMIT_NPROC: PROCESSES, resource.RLIMIT_AS: memory_mb << 20}
    for what, most in wanted.items():
        hard = resource.getrlimit(what)[1]
        bound = most if hard == resource.RLIM_INFINITY else min(most, hard)
        resource.setrlimit(what, (bound, bound))


def guard():
    """Takes functions and modules away from this process for good."""
    import builtins
    import io

    low = sys.modules.get("posix")
    for name in [*NO_OS, *(n for n in dir(os) if n.startswith(tuple(NO_OS_BEGINNINGS)))]:
        for module in (os, low):
            if hasattr(module, name):
                setattr(module, name, None)
    for name in NO_SHUTIL:
        setattr(shutil, name, None)
    for name in NO_BUILTINS:
        setattr(builtins, name, None)
    io.open = None
    for name in NO_MODULES:
        for held in [m for m in sys.modules if m == name or m.startswith(name + ".")]:
            sys.modules[held] = None
        sys.modules[name] = None


def child(program, seconds, memory_mb, folder, told):
    """Never returns. told: the pipe that says how the program ended."""
    write, leave = os.write, os._exit
    os.setsid()
    os.chdir(folder)
    nothing = os.open(os.devnull, os.O_RDWR)
    for stream in (0, 1, 2):
        os.dup2(nothing, stream)
    os.environ.clear()
    os.environ.update(PATH="", HOME=folder)
    limit(seconds, memory_mb)
    guard()
    try:
        exec(compile(program, "<program>", "exec"), {"__name__": "__main__"})
        result = "passed"
    except BaseException as e:
        said = str(e).strip().splitlines()
        result = "failed: " + type(e).__name__ + (": " + said[-1] if said else "")
    write(told, result[:400].encode("utf-8", "replace"))
    leave(0)


def run(program, seconds, memory_mb):
    """What became of a program: passed, failed: ..., timed out, died of signal N, or that it ended without a word."""
    folder = tempfile.mkdtemp()
    read, write = os.pipe()
    pid = os.fork()
    if not pid:
        try:
            os.close(read)
            child(program, seconds, memory_mb, folder, write)
        finally:
            os._exit(1)
    os.close(write)
    said, ends = b"", time.monotonic() + seconds
    try:
        while True:
            left = ends - time.monotonic()
            if left <= 0 or not select.select([read], [], [], left)[0]:
                return "timed out"
            part = os.read(read, 4096)
            if not part:
                break
            said += part
        while time.monotonic() < ends:
            done, state = os.waitpid(pid, os.WNOHANG)
            if done:
                pid = 0
                if os.WIFSIGNALED(state):
                    return "died of signal %d" % os.WTERMSIG(state)
                return said.decode("utf-8", "replace") or "failed: it ended without a result"
            time.sleep(0.0005)
        return "timed out"
    finally:
        os.close(read)
        if pid:
            for kill in (os.killpg, os.kill):
                try:
                    kill(pid, signal.SIGKILL)
                except OSError:
                    pass
            os.waitpid(pid, 0)
        shutil.rmtree(folder, ignore_errors=True)


def serve(source, answers):
    while line := source.readline():
        asked = json.loads(line)
        try:
            result = run(source.read(asked["bytes"]), asked["seconds"], asked["memory_mb"])
        except OSError as e:
            result = "could not start: %s" % e
        answers.write((json.dumps({"result": result}) + "\n").encode())
        answers.flush()


if __name__ == "__main__":
    serve(sys.stdin.buffer, sys.stdout.buffer)
