"""What a report must say about the error rates of a flattened comparison."""

from __future__ import annotations

from tracewright.operators.deep import INCONCLUSIVE_TOKENS, NORMALIZE_THRESHOLD

# The measured operating point of the flattened channel.
FP_RATE, FP_LOW, FP_HIGH, FP_PAIRS, RECALL_VERBATIM, MAX_TOKENS = 0.95, 0.17, 5.2, "1/105", 65, 212


def normalize_disclosure(threshold: float, provenance: str) -> str:
    """One paragraph: the inflation of false positives, the floor, and the measured rate where it applies."""
    text = f"Flattening identifiers raises the rate of false positives among independent code of one subject; matches of fewer than {INCONCLUSIVE_TOKENS} tokens are inconclusive."
    if provenance == "normalize-default" or threshold == NORMALIZE_THRESHOLD:
        return (
            f"{text} At threshold {NORMALIZE_THRESHOLD:.0f}, calibrated for at most 1% false positives, the measured rate is {FP_RATE:.2g}% (Wilson 95% interval "
            f"{FP_LOW:.2g} to {FP_HIGH:.2g}%, {FP_PAIRS} file pairs of at most {MAX_TOKENS} tokens). About {RECALL_VERBATIM}% of near-verbatim copies and almost no "
            "heavily restructured ones are found: a match indicates near-verbatim similarity."
        )
    return f"{text} Threshold {threshold:.0f} was set by hand; the rate measured at threshold {NORMALIZE_THRESHOLD:.0f} ({FP_RATE:.2g}%, interval {FP_LOW:.2g} to {FP_HIGH:.2g}%) does not apply to it."
