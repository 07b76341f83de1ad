"""Fixed values of the game log: they must stay as they are for right results."""

ASSESSMENT = "Assessment"
TYPES = ["Game", "Assessment", "Activity", "Clip"]
WORLDS = ["NONE", "MAGMAPEAK", "TREETOPCITY", "CRYSTALCAVES"]
TIMED_WORLDS = ["CRYSTALCAVES", "MAGMAPEAK", "TREETOPCITY"]

# An attempt is code 4100, but 4110 on this one title.
ATTEMPT_CODE = 4100
OTHER_ATTEMPT_CODE = 4110
OTHER_ATTEMPT_TITLE = "Bird Measurer (Assessment)"

# Characters stripped from the right of an assessment title.
TITLE_TAIL = " (Assessment)"

PLAYER = "installation_id"
SESSION = "game_session"
KEYS = [PLAYER, SESSION]
