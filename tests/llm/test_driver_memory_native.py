"""The driver's JVM gives back what it has freed outside its heap."""

import sys

import pytest

from layover.llm import scratch


@pytest.mark.skipif(sys.platform != "linux", reason="the command is there on Linux only")
def test_release_trims_the_native_heap(spark, monkeypatch):
    answers, trim = [], scratch.trim_jvm
    monkeypatch.setattr(scratch, "trim_jvm", lambda s: answers.append(trim(s)))
    scratch.release(spark)
    assert len(answers) == 1 and "Trim native heap" in answers[0]


def test_a_session_without_the_command_goes_on():
    def array(kind, size):
        raise scratch.Py4JError("no such command")

    class Any:
        def __getattr__(self, name):
            return self

    context = type("Context", (), {"_jvm": Any(), "_gateway": type("Gateway", (), {"new_array": staticmethod(array)})})
    assert scratch.trim_jvm(type("Session", (), {"sparkContext": context})) is None
