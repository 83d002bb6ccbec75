"""A chat for tests: answers in JSON and names what it was told."""

import json


def chat(system: str, user: str) -> str:
    return json.dumps({"explanation": user.splitlines()[0], "interview_questions": [{"question": "Who wrote it?", "targets": "general"}, {"question": " "}]})


def broken(system: str, user: str) -> str:
    raise OSError("no line")
