"""Running a rebuild plan: clean builds are skipped, failures cascade to members, state is saved as it goes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field


@dataclass
class Outcome:
    built: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)


def run_plan(
    tasks: Mapping[str, str],
    members: Mapping[str, list[str]],
    state: dict,
    build: Callable[[str], None],
    verify: Callable[[str], bool],
    save: Callable[[dict], None],
    workers: int = 2,
) -> Outcome:
    """Build every task (key -> fingerprint), groups first; one failure doesn't stop the others.

    A task whose fingerprint is the stored one is skipped. A group that fails or
    isn't verified is dropped, and its members are built by themselves in a second
    wave. The state is saved after each success, so a broken run resumes.
    """
    out = Outcome()

    def wave(keys: list[str]) -> list[str]:
        todo = []
        for k in keys:
            (out.skipped if state["feeds"].get(k, {}).get("fingerprint") == tasks.get(k, "") != "" else todo).append(k)

        def one(k: str) -> tuple[str, str]:
            try:
                build(k)
                return k, "" if not members.get(k) or verify(k) else "lost too much of its members"
            except Exception as e:  # a failed build is an outcome here, reported by name
                return k, str(e) or type(e).__name__

        bad = []
        with ThreadPoolExecutor(workers) as pool:
            for k, error in pool.map(one, todo):
                if error:
                    out.failed[k] = error
                    bad.append(k)
                else:
                    state["feeds"].setdefault(k, {})["fingerprint"] = tasks.get(k, "")
                    save(state)
                    out.built.append(k)
        return bad

    bad = wave(sorted(tasks, key=lambda k: (not members.get(k), k)))
    again = sorted({m for g in bad for m in members.get(g, [])} - set(out.built))
    out.dropped = [g for g in bad if members.get(g)]
    if again:
        for m in again:
            state["feeds"].get(m, {}).pop("fingerprint", None)
        wave(again)
    return out
