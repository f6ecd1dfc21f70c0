"""A Python function used by the registered queries."""


def initials(text):
    return text[:2].upper()
