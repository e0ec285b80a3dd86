"""What chat models are told. Templates take {names}; doubled braces stand for themselves."""

from __future__ import annotations

EXTRACT_SYSTEM = """You read a passage and note the knowledge graph in it.
Domain: {domain}
Questions the graph is to answer: {examples}
Allowed entity types: {types}

Reply with one JSON object and nothing else:
{{"entities": [{{"name": "...", "type": "...", "desc": "..."}}],
 "relationships": [{{"source": "...", "target": "...", "desc": "..."}}],
 "other_relationships": [{{"source": "...", "target": "...", "desc": "..."}}]}}
Names are written out in full, never as pronouns. Each description is one sentence that the passage supports. Ends of
relationships are names from the list of entities; relationships that leave an entity otherwise untied go into
other_relationships."""
EXTRACT = "Passage:\n{text}"
EXTRACT_MORE = "Entities and relationships were missed. Give only those, in the same form."
EXTRACT_DONE = 'Is anything still missing? Reply with {"status": "done"} or {"status": "continue"}.'
QUESTION = """List what has to be looked up to answer the question below, as JSON of this form:
{{"named": ["proper names in the question"], "generic": ["other things it is about"]}}
Question: {text}"""
SUMMARY_SYSTEM = "You shorten notes about one entity without losing facts."
SUMMARY = 'Join these notes into one description of at most {limit} letters. Reply with {{"description": "..."}}.\n{description}'
GROUP_SYSTEM = "You are given numbered statements about the same two things."
GROUP = """Put statements that say the same into groups, each with one sentence that stands for all of them. Leave the others out.
Reply with {{"groups": [{{"ids": [0, 1], "description": "..."}}]}}.
{listing}"""
ANSWER = """Answer the question from the context alone, and say so if it does not hold the answer.
Context:
{context}

Question: {question}"""
ANSWER_WITH_REFERENCES = """Answer the question from the context alone, and say so if it does not hold the answer. After each
statement name the sources that support it by their numbers, like [2] or [1][4].
Context:
{context}

Question: {question}"""


def types_text(types: list[str]) -> str:
    """Entity types as prompts name them."""
    return ",".join(types)
