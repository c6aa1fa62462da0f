"""The client protocol, a deterministic stand-in, and flow control: an additive-increase limiter and retries."""

from __future__ import annotations

import hashlib
import json
import random
import time
from dataclasses import dataclass
from typing import Protocol


@dataclass
class Answer:
    text: str
    input_tokens: int
    output_tokens: int
    truncated: bool = False


class Throttled(Exception):
    """The service asks to slow down."""


class Client(Protocol):
    """Something that answers; it is pickled to the executors."""

    model: str

    def answer(self, stage: str, system: str, text: str, max_tokens: int) -> Answer: ...


#: Tokens that a model may think for, besides those of its answer.
THINKING = 16_000


def streamed(client: Client, stage: str, system: str, text: str, max_tokens: int, tell, thinking: int = THINKING) -> Answer:
    """The answer of a client, told in pieces as they come: tell(text, whether it is thought or said).

    A client that streams has stream(stage, system, text, max_tokens, thinking), which yields such pairs and last an Answer, whose text is what
    was said; max_tokens is for the answer alone.  One that does not is asked for its whole answer, which is one piece.
    """
    if not hasattr(client, "stream"):
        answer = client.answer(stage, system, text, max_tokens)
        tell(answer.text, False)
        return answer
    said = []
    for piece in client.stream(stage, system, text, max_tokens + thinking, thinking):
        if isinstance(piece, Answer):
            return piece if piece.text else Answer("".join(said), piece.input_tokens, piece.output_tokens, piece.truncated)
        words, thought = piece
        if not thought:
            said.append(words)
        tell(words, thought)
    return Answer("".join(said), 0, 0, True)  # it broke off


class StubClient:
    """Answers by rule, the same for the same request; chosen by the request's stage, never by its prompt."""

    model = "stub"

    def answer(self, stage: str, system: str, text: str, max_tokens: int) -> Answer:
        return Answer(getattr(self, "_" + stage, self._summarize)(text), 100, 50)

    def _observe(self, text: str) -> str:
        owner = [p.split("\n\n")[0] for p in text.split("[owner]: ")[1:]]
        return "\n".join(f"Observation: {p.replace(chr(10), ' ')[:80]}" for p in owner if p.strip())

    def _refine(self, text: str) -> str:
        return text

    def _label(self, text: str) -> str:
        out = []
        for line in text.split("\n"):
            n, dot, body = line.partition(". ")
            if dot and n.isdigit():
                out.append(f"{n}. pattern {int(hashlib.md5(body.encode()).hexdigest()[:4], 16) % 97}")
        return "\n".join(out)

    def _theme_identify(self, text: str) -> str:
        return "\n".join(f"THEME: theme {i}" for i in range(20))

    def _theme_map(self, text: str) -> str:
        labels = [line.removeprefix("- ") for line in text.partition("LABELS:\n")[2].splitlines()]
        return "\n".join(f"{x} -> theme {int(hashlib.md5(x.encode()).hexdigest()[:4], 16) % 20}" for x in labels)

    def _summarize(self, text: str) -> str:
        return f"{len(text.splitlines())} lines"

    def _judge(self, text: str) -> str:
        h = hashlib.md5(text.encode()).hexdigest()
        side = lambda i: " ".join(f"{d}={int(h[i + k], 16) % 6}" for k, d in enumerate(("reasoning", "voice", "awareness")))
        return f"RESPONSE_A: {side(0)}\nRESPONSE_B: {side(3)}"

    def _compare(self, text: str) -> str:
        side = lambda t: " ".join(f"{d}={int(hashlib.md5((d + t).encode()).hexdigest()[0], 16) % 6}" for d in ("coverage", "accuracy", "density", "voice", "actionability"))
        a, b = text.partition("\n\nOBSERVATIONS:\n")[0].removeprefix("RESPONSE A:\n").split("\n\nRESPONSE B:\n")
        return f"RESPONSE_A: {side(a)}\nRESPONSE_B: {side(b)}"

    def _prefer(self, text: str) -> str:
        return f"PREFERRED: {'AB'[int(hashlib.md5(text.encode()).hexdigest()[0], 16) % 2]}\nRATIONALE: by rule"

    def _questions(self, text: str) -> str:
        found = [{"id": f"q{i}", "category": "domain", "prompt": f"What about line {i}?"} for i in range(1, min(10, len(text.splitlines())) + 1)]
        return f"Here:\n```json\n{json.dumps(found)}\n```"

    def _update(self, text: str) -> str:
        document, _, new = text.removeprefix("DOCUMENT:\n").partition("\n\nOBSERVATIONS:\n")
        return "\n".join([*document.splitlines(), *new.splitlines()][-40:])

    def _thesis(self, text: str) -> str:
        return "\n".join(line.removeprefix("### ") for line in text.splitlines() if line.startswith("### Cluster"))

    def _compose(self, text: str) -> str:
        return "```markdown\n# Profile\n" + text + "\n```"


class Limiter:
    """Requests a second: one more after ten successes, half on a throttle (five seconds apart), the seed again after thirty calm ones."""

    def __init__(self, seed: float = 20, least: float = 1, most: float = 50, clock=time.monotonic, sleep=time.sleep):
        self.seed, self.most, self.least = seed, most, min(least, most)
        self.rate, self.clock, self.sleep = seed, clock, sleep
        self.good, self.last_throttle, self.next = 0, None, clock()

    def acquire(self) -> None:
        now = self.clock()
        if self.last_throttle is not None and now - self.last_throttle > 30 and self.rate < self.seed:
            self.rate = self.seed
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + 1 / self.rate

    def success(self) -> None:
        self.good += 1
        if self.good >= 10:
            self.good, self.rate = 0, min(self.most, self.rate + 1)

    def throttled(self) -> None:
        now, self.good = self.clock(), 0
        if self.last_throttle is None or now - self.last_throttle >= 5:
            self.rate, self.last_throttle = max(self.least, self.rate / 2), now


def with_retry(call, limiter: Limiter, attempts: int = 5, base: float = 2.0, most: float = 60.0, rng: random.Random | None = None):
    """The call's result; throttles are tried again after min(base * 2 ** n, most) * U(0.5, 1), other errors are raised."""
    rng = rng or random.Random()
    for n in range(attempts):
        limiter.acquire()
        try:
            out = call()
        except Throttled:
            limiter.throttled()
            if n == attempts - 1:
                raise
            limiter.sleep(min(base * 2**n, most) * rng.uniform(0.5, 1))
        else:
            limiter.success()
            return out


#: Requests a second that services take, at the start and at most, by service.
RATES = {"code-core": (1.3, 1.4), "code-search": (0.45, 0.5), "chat-search": (0.5, 0.5), "chat-replies": (2.0, 2.0), "model-a": (60, 66), "model-b": (50, 166), "model": (20, 50)}


def limiter_for(service: str, **more) -> Limiter:
    """The limiter of a service; the smallest rate that it falls to is 1, or the service's own most."""
    seed, most = RATES[service]
    return Limiter(seed, most=most, **more)
