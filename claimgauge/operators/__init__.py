"""Lazy DataFrame operators: summaries, detectors, scoring, registry, dossier."""
