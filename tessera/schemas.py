"""Explicit schemas of the model's tables; production reads never infer."""

from __future__ import annotations

LEVEL = "struct<mean:double,std:double,start:double,end:double>"
LABELS = f"struct<primary:string,scores:map<string,double>,secondary:string,votes:map<string,bigint>,mean:double,valence:{LEVEL},arousal:{LEVEL},dominance:{LEVEL},max_cough_prob:double>"

SEGMENTS = f"seg_id string, episode_id string, start double, `end` double, speaker string, text string, domain_labels {LABELS}, audio_faiss_idx bigint, text_faiss_idx bigint, domain_faiss_idxs array<bigint>"
TURNS = "episode_id string, turn_idx int, start double, `end` double, speaker string, text string"
VECTORS = "space string, idx bigint, seg_id string, episode_id string, start double, `end` double, embedding array<float>"
PLAN_SETS = "query_id bigint, set_no int, localize string, time boolean, keyword string, label string, text_emb string, audio_emb string, domain_emb string"
PLAN_JSON = "struct<sets:array<struct<localize:string,time:boolean,keyword:string,label:string,text_emb:string,audio_emb:string,domain_emb:string>>>"
HITS = "query_id bigint, set_no int, seg_id string, source string, score double, modality_ord int, hit_ord bigint"
SCORES = "variant string, judge string, query_id bigint, episode_id string, answer int, factual int, faithful int, rationale int, retrieval_hit_rate double, plan_hit_rate double"
TRACES = "episode_id string, dim string, annotator_id string, start double, `end` double, mean double"
HUMAN_ANSWERS = "source string, query_id bigint, query_type string, choice array<string>, sure string, difficulty int"
EPISODES = "episode_id string, audio_path string"
SONGS = "track_name string, file_name string, start_time double, end_time double, gender string, annotation array<struct<Coherence:double,Musicality:double,Memorability:double,Clarity:double,Naturalness:double>>"
CONSENSUS = "FileName string, EmoClass string, EmoAct double, EmoVal double, EmoDom double, SpkrID string, Gender string"
DETAILED = "FileName string, EmoClass_Major string"
