"""The model client against a server on this machine that fails in the ways servers fail."""

import json
import socket
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lumenfold import cli
from lumenfold.operators import inference, preparation
from lumenfold.operators.inference import ContextOverflow, FatalRequest, Overloaded
from lumenfold.plans import registry, runner
from lumenfold.sources import committed
from lumenfold.sources.model_server import MalformedAnswer, ModelServer

RIGHT = {"choices": [{"message": {"content": "fine"}}]}


def told(content):
    return {"choices": [{"message": {"content": content}}]}


def alternatives(*pairs):
    return {"choices": [{"logprobs": {"content": [{"top_logprobs": [{"token": t, "logprob": p} for t, p in pairs]}]}}]}


def spelled(text):
    """An echoed text as tokens of two characters, each of log-probability minus its place."""
    tokens = [text[i : i + 2] for i in range(0, len(text), 2)]
    return {"choices": [{"logprobs": {"text_offset": [2 * i for i in range(len(tokens))], "tokens": tokens, "token_logprobs": [None, *(-float(i) for i in range(1, len(tokens)))]}}]}


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *_):
        pass

    def do_POST(self):
        s = self.server
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        words = asked["messages"][-1]["content"] if "messages" in asked else asked["prompt"]
        with s.lock:
            s.seen.append((self.path, self.headers["Authorization"], asked))
            s.connections.add(self.client_address)
            s.asked[words] += 1
            nth = s.asked[words]
        kind = words.split(" ")[0]
        status, answer = 200, RIGHT
        if kind in ("429", "408", "500", "400", "401") and (nth == 1 or len(words.split(" ")) > 1):
            status, answer = int(kind), {"error": {"message": "maximum context length" if "long" in words else "no"}}
        elif kind == "cut" and nth == 1:
            self.connection.shutdown(socket.SHUT_RDWR)
            self.connection.close()
            return
        elif kind == "half" and nth == 1:
            self.wfile.write(b"HTTP/1.1 200 OK\r\nContent-Length: 500\r\n\r\n{")
            self.connection.shutdown(socket.SHUT_RDWR)
            return
        elif kind in ("blank", "none", "number", "nochoice", "text") and nth == 1:
            answer = {"blank": told(" \n"), "none": told(None), "number": told(5), "nochoice": {"choices": []}, "text": "text"}[kind]
        elif kind == "empty":
            answer = told("")
        elif "echo" in asked:
            answer = spelled(asked["prompt"])
        elif "logprobs" in asked:
            answer = alternatives((" a", -2.0), ("A", -1.0), ("b", -0.5), (" a", -3.0)) if kind != "inf" else alternatives(("A", None))
        body = json.dumps(answer).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.seen, s.asked, s.connections, s.lock, s.daemon_threads = [], Counter(), set(), threading.Lock(), True
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url = f"http://127.0.0.1:{s.server_port}/v1"
    yield s
    s.shutdown()


@pytest.mark.parametrize("prompt,fault", [
    ("429", Overloaded), ("408", Overloaded), ("500", Overloaded), ("400 x", FatalRequest), ("401 x", FatalRequest), ("400 long", ContextOverflow), ("429 long", ContextOverflow), ("500 long", ContextOverflow),
    ("cut", Overloaded), ("half", Overloaded), ("blank", MalformedAnswer), ("none", MalformedAnswer), ("number", MalformedAnswer), ("nochoice", MalformedAnswer), ("text", MalformedAnswer), (" ", FatalRequest),
])
def test_faults_by_kind(server, prompt, fault):
    client = ModelServer(server.url, "m")()
    with pytest.raises(fault) as e:
        client.generate(prompt, None, 1)
    assert type(e.value) is fault
    if fault in (Overloaded, MalformedAnswer):
        assert client.generate(prompt, None, 1) == "fine"  # on a new connection where the old one was cut


def test_requests_carry_settings_and_connections_are_kept(server, monkeypatch):
    monkeypatch.setenv("A_KEY", "secret")
    client = ModelServer(server.url, "m", 99, 0.5, 0.9, key_variable="A_KEY", extra={"top_k": 5})()
    assert [client.generate(f"q{i}", "be brief", i) for i in range(5)] == ["fine"] * 5 and client.generate("empty", None, 0) == ""
    path, key, asked = server.seen[3]
    assert (path, key) == ("/v1/chat/completions", "Bearer secret") and len(server.connections) == 1
    assert asked == {"model": "m", "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "q3"}], "max_completion_tokens": 99, "temperature": 0.5, "top_p": 0.9, "seed": 3, "top_k": 5}


def test_log_probabilities(server):
    client = ModelServer(server.url, "m")()
    assert client.alternatives("q") == {" a": -2.0, "A": -1.0, "b": -0.5}
    assert client.echo("abcde") == ([0, 2, 4], ["ab", "cd", "e"], [None, -1.0, -2.0])
    with pytest.raises(MalformedAnswer):
        client.alternatives("inf")


def test_a_server_that_is_not_there():
    with pytest.raises(Overloaded):
        ModelServer("http://127.0.0.1:9", "m", timeout=1)().generate("q", None, 0)


@pytest.mark.parametrize("settings", [{"base_url": "ftp://x"}, {"base_url": "here"}, {"model": ""}, {"timeout": 0}, {"max_tokens": 0}])
def test_settings_are_checked(settings):
    with pytest.raises(ValueError):
        ModelServer(**{"base_url": "http://h/v1", "model": "m", **settings})


def test_generation_in_executors(spark, server):
    rows = spark.createDataFrame([(p, 1) for p in ("q", "429", "cut", "blank", "400 x", "400 long", "empty", "500 x")], "prompt string, seed int").repartition(2)
    found = {r.prompt: (r.gen, r.error) for r in inference.generate(rows, ModelServer(server.url, "m"), attempts=3, sleep=lambda _: None).collect()}
    assert [found[p] for p in ("q", "429", "cut", "blank", "empty", "400 long")] == [("fine", None)] * 4 + [("", None), (None, None)]
    assert found["400 x"][1].startswith("FatalRequest") and server.asked["400 x"] == 1 and found["500 x"][1].startswith("Overloaded") and server.asked["500 x"] == 3


def test_choices_in_executors(spark, server):
    rows = spark.createDataFrame([("p?", ["x", "y"], 0)], "prompt string, choices array<string>, gold int")
    first = inference.score_choices(rows, ModelServer(server.url, "m"), "first_token").first()
    assert first.logprobs == [-1.0, -0.5] and first.error is None
    echoed = inference.score_choices(rows.withColumn("choice_tokens", F.array(F.lit("ab"), F.lit("abcd"))), ModelServer(server.url, "m"), "continuation").first()
    assert echoed.error is not None or len(echoed.logprobs) == 2


def test_runs_go_on_where_they_stopped(spark, server, tmp_path):
    questions = spark.createDataFrame([("a", "q1"), ("b", "400 x"), ("c", "q2")], "doc_id string, prompt string")
    run = runner.Run(str(tmp_path / "out"), n_samples=2, tasks=2, attempts=1)
    with pytest.raises(runner.IncompleteRun) as e:
        runner.execute(questions, run, ModelServer(server.url, "m"))
    assert (e.value.counts["requested"], e.value.counts["failed"]) == (6, 2) and not runner.is_complete(questions, run)
    server.asked.clear()
    with pytest.raises(runner.IncompleteRun):
        runner.execute(questions, run, ModelServer(server.url, "m"))
    assert dict(server.asked) == {"400 x": 2}
    for prompt, fault in (("<|im_start|>user", "chat template"), (" ", "blank")):
        with pytest.raises(ValueError, match=fault):
            runner.execute(questions.withColumn("prompt", F.lit(prompt)), runner.Run(str(tmp_path / "other")), ModelServer(server.url, "m"))


def test_command_lines_from_questions_to_a_result(spark, server, tmp_path, capsys):
    (tmp_path / "source.jsonl").write_text("".join(json.dumps({"question": f" what is {i}? ", "answer": "fine" if i % 2 else "bad"}) + "\n" for i in range(6)))
    prepare = ["prepare", "bench", str(tmp_path / "source.jsonl"), "--output", str(tmp_path / "b"), "--kind", "math"]
    assert cli.main(prepare) == cli.main(prepare) == 0
    folder = preparation.published(spark, str(tmp_path / "b" / "bench"))
    assert sorted(r.doc_id for r in spark.read.json(folder).collect()) == [f"bench:{i}" for i in range(6)]
    pool = tmp_path / "pool.jsonl"
    pool.write_text("".join(json.dumps({"doc_id": f"d{i}", "prompt": f"demo {i}", "answer": "yes"}) + "\n" for i in range(4)))
    infer = ["infer", folder, "--output", str(tmp_path / "out"), "--url", server.url, "--model", "m", "--n-samples", "2", "--tasks", "2", "--shots", "2", "--pool", str(pool), "--seed", "3"]
    assert cli.main(infer) == 0 and len(server.seen) == 12
    assert all(asked["messages"][0]["content"].count("demo") == 2 and "what is" in asked["messages"][0]["content"] for _, _, asked in server.seen)
    assert cli.main(infer) == 0 and len(server.seen) == 12
    done = ["evaluate", str(tmp_path / "out"), "--task", "math_opensource/bench", "--output", str(tmp_path / "r.json"), "--artifacts", str(tmp_path / "a"), "--resamples", "20"]
    assert cli.main(done) == 0
    result = json.loads((tmp_path / "r.json").read_text())
    assert result["metrics"]["accuracy"]["value"] == 0.5 and result["details"]["complete_problem_count"] == 6
    assert committed.current(spark, str(tmp_path / "a"))["result"] == result
    rows, problems = (committed.read(spark, str(tmp_path / "a"), table=t) for t in ("rows", "problems"))
    assert rows.count() == 12 and problems.filter("complete and k = 2").count() == 6 and rows.first().filter_trace.pipeline == "response" and {r.task for r in rows.collect()} == {"math_opensource/bench"}
    assert "math_opensource/bench: 0.500000" in capsys.readouterr().out
    (tmp_path / "few.jsonl").write_text(json.dumps({"prompt": "p", "answer": "a"}) + "\n")
    with pytest.raises(ValueError, match="fewer than 2"):
        cli.main([*infer[:-4], "--pool", str(tmp_path / "few.jsonl")])


def test_command_line_of_choices(spark, server, tmp_path):
    (tmp_path / "q.jsonl").write_text(json.dumps({"doc_id": "1", "prompt": "p", "choices": ["x", "y"], "gold": 0}) + "\n")
    infer = ["infer", str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "out"), "--url", server.url, "--model", "m", "--tasks", "1"]
    assert cli.main([*infer, "--mode", "first_token"]) == 0
    assert cli.main(["evaluate", str(tmp_path / "out"), "--task", "mc/x", "--output", str(tmp_path / "r.json")]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["metrics"]["acc"]["value"] == 0.0  # B is likelier than A
    for more in (["--shots", "1"], ["--mode", "continuation", "--system", "s"]):
        with pytest.raises(SystemExit):
            cli.main([*infer, *more])


def test_labels_are_keys_of_every_row(spark, tmp_path):
    path = tmp_path / "o.jsonl"
    path.write_text('{"doc_id": "a", "answer": ["$7$", "8"], "gen": "7"}\n{"doc_id": "b", "answer": [], "gen": "7"}\n{"doc_id": "c", "answer": null, "gen": "7"}\n')
    result = registry.evaluate(cli.load(spark, str(path)).drop("logprobs"), "math_opensource/o", registry.Options("olympiadbench", resamples=0))
    assert (result["metrics"]["accuracy"]["value"], result["failed_count"]) == (1.0, 2)
    path.write_text('{"doc_id": "a", "answer": "1", "gen": "7"}\n{"doc_id": "b", "gen": "7"}\n')
    with pytest.raises(Exception, match="no answer"):
        registry.evaluate(cli.load(spark, str(path)).drop("logprobs"), "math_opensource/o")
    with pytest.raises(ValueError, match="'answer'"):
        registry.evaluate(spark.createDataFrame([("a", "1")], "doc_id string, gen string"), "math_opensource/o")


def test_scorers_give_the_metrics_they_declare(spark):
    rows = spark.createDataFrame([("a", "1", "1")], "doc_id string, answer string, gen string")
    for metrics, observed, told in (({}, "accuracy", "left out"), ({"accuracy": 0.0}, "other", "no metrics")):
        scorer = lambda r, o, m=metrics, x=observed: registry.Scored(m, r.select(F.lit(x).alias("metric"), F.lit(1.0).alias("value"), "ordinal"), registry.score_math(r, o).counts)
        registry.register("mine", scorer, ["accuracy"])
        with pytest.raises(ValueError, match=told):
            registry.evaluate(rows, "mine/x", registry.Options(resamples=0))
    del registry.FAMILIES["mine"], registry.DECLARED["mine"]


def test_all_incomplete_problems_are_in_the_table(spark, tmp_path):
    rows = [(f"p{(37 * i) % 150}", i, "1", "1", 2 if i % 3 else 1) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id string, ordinal long, answer string, gen string, n_samples int").repartition(4)
    result = registry.evaluate(frame, "math_opensource/x", registry.Options(resamples=0), str(tmp_path / "a"))
    want = [r[0] for r in rows if r[4] == 2]
    assert result["details"]["incomplete_problem_count"] == 100 and result["details"]["incomplete_problem_ids"] == want[:100]
    table = committed.read(spark, str(tmp_path / "a"), table="problems").filter("not complete").orderBy("place").collect()
    assert [r.problem for r in table] == [f"doc:{x}" for x in want]
