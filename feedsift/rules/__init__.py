"""Default rule data: profiles, regions, text signals, skills, feeds."""
