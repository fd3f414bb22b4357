"""Fixed values of the pool's formulas."""

SEARCHABLE = ("approved", "auto_approved", "edited")
DIMS = ("outcome", "intent", "execution", "orchestration", "expression")
#: Three weight sets that must stay apart: the learned Q, the trajectory score, and the summary of turn rewards.
Q_WEIGHTS = {"outcome": 0.30, "intent": 0.20, "execution": 0.20, "orchestration": 0.15, "expression": 0.15}
SCORE_WEIGHTS = {"outcome": 0.40, "intent": 0.20, "execution": 0.15, "orchestration": 0.10, "expression": 0.15}
SUMMARY_WEIGHTS = {"outcome": 0.35, "intent": 0.20, "execution": 0.20, "orchestration": 0.10, "expression": 0.15}
W_SIMILARITY, W_Q, C_EXPLORATION = 0.55, 0.35, 0.10
W_VECTOR, W_KEYWORD = 0.7, 0.3
ALPHA = 0.2
DEDUP_INTENT, DEDUP_SCRIPT = 0.85, 0.78
DIVERGENCE = 0.5
JUDGE_VARIANCE, ENSEMBLE_GAP, ENSEMBLE_PENALTY = 0.05, 0.4, 0.6
DRIFT = 0.15
MEMORY_SCORE, SFT_SCORE = 0.0, 0.4
CLUSTER_SIMILARITY, CLUSTER_MIN, CLUSTER_NEW = 0.75, 5, 3
COMMUNITY_UNLOCK = 3
EMBEDDING_SIZE = 256
FEEDBACK_CONFIDENCE = 0.35
