"""All queries over the reference's operators, by name."""

from plenum.plans import caption_queries, episode_queries, identity_queries, matching_queries, minutes_queries, motion_queries, publish_queries, record_queries, relational_queries, roster_queries, rule_queries, sequential_queries, stream_queries, text_queries, time_queries, upkeep_queries

QUERIES, ORACLES = {}, {}
for module in (time_queries, identity_queries, relational_queries, text_queries, stream_queries, sequential_queries, minutes_queries, rule_queries, matching_queries, upkeep_queries, record_queries, motion_queries, caption_queries, roster_queries, episode_queries, publish_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
