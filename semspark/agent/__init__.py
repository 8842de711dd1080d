"""A planner that turns a task into typed DataFrame steps; no generated code is run."""

from .expressions import register_function, register_table_function
from .interpreter import Agent, AgentError, StepCounts, run_plan
from .steps import STEPS, PlanError

__all__ = ["Agent", "AgentError", "PlanError", "STEPS", "StepCounts", "register_function", "register_table_function", "run_plan"]
