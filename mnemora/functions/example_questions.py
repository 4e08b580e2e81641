"""The example questions of each category, in order."""

from __future__ import annotations

EXAMPLES = {
    "declarative": [
        "what is the capital of France?",
        "who was the first president of the United States?",
        "when did World War II end?",
        "where is the Great Barrier Reef located?",
        "what is the speed of light?",
        "tell me about quantum physics",
        "what are the components of DNA?",
        "who invented the telephone?",
        "what is the population of Tokyo?",
        "what are the main export products of Brazil?",
        "define photosynthesis",
        "what is the meaning of the word 'ephemeral'?",
        "what causes lightning?",
        "who wrote War and Peace?",
        "what is the height of Mount Everest?",
        "what is 5 + 3?",
        "calculate 10 - 7",
        "what's 7 times 8",
        "what's the result of 12 * 4?",
        "divide 100 by 5",
    ],
    "procedural_knowledge": [
        "how to bake a chocolate cake?",
        "what are the steps to change a car tire?",
        "how do I reset my password?",
        "guide for installing Python on Windows",
        "how to fix a leaky faucet?",
        "what's the process for applying to a university?",
        "instructions for assembling IKEA furniture",
        "how to grow tomatoes from seeds?",
        "steps to create a website",
        "how do I perform CPR?",
        "what's the technique for making perfect sushi rice?",
        "how to train a dog to sit?",
        "what's the proper way to meditate?",
        "how do I create a budget spreadsheet?",
        "what's the method for solving quadratic equations?",
    ],
    "experiential": [
        "what is it like to climb Mount Everest?",
        "how does it feel to win an Olympic medal?",
        "what was your experience visiting Japan?",
        "share your experience of childbirth",
        "what happens when you skydive for the first time?",
        "have you ever been to the Amazon rainforest?",
        "what's it like to work at Google?",
        "how does depression feel?",
        "what was it like growing up in the 1980s?",
        "describe the experience of running a marathon",
        "what's it like to live in New York City?",
        "how does it feel to learn a new language?",
        "what was it like to witness a solar eclipse?",
        "share your experience with meditation",
        "what happens during acupuncture?",
    ],
    "tacit": [
        "what's your intuition about the stock market?",
        "what do you think about this painting?",
        "should I quit my job to travel the world?",
        "how can I tell if someone is lying?",
        "what's your perspective on artificial intelligence ethics?",
        "how do I know if I'm making the right decision?",
        "what would you do in my situation?",
        "how can I become a better listener?",
        "what's your advice on public speaking?",
        "how do you know when to trust someone?",
        "what's your gut feeling about this business proposal?",
        "how can I improve my leadership skills?",
        "what makes a good teacher?",
        "how do you handle difficult conversations?",
        "what's the secret to maintaining work-life balance?",
    ],
    "explicit": [
        "what does the user manual say about resetting the device?",
        "according to the Constitution, who has the power to declare war?",
        "what are the specifications of the iPhone 13?",
        "what does the Chicago Manual of Style say about Oxford commas?",
        "as stated in the company policy, what is the vacation allowance?",
        "what are the instructions in the assembly guide?",
        "what does the research paper conclude about climate change?",
        "according to the recipe, how much flour should I use?",
        "what does the API documentation specify for this function?",
        "what are the rules of chess according to the official handbook?",
        "what does the tax code say about deducting home office expenses?",
        "according to safety regulations, what protective equipment is required?",
        "what does the textbook explain about photosynthesis?",
        "what are the terms and conditions for this service?",
        "what does the contract specify about termination?",
        "how do you say hello in French?",
        "translate book to Spanish",
        "how to say thank you in Japanese",
        "what is the German word for water?",
    ],
    "conceptual_knowledge": [
        "explain the theory of relativity",
        "what is the principle of natural selection?",
        "why does supply and demand affect prices?",
        "what is the concept of justice in philosophy?",
        "explain the principles of object-oriented programming",
        "what is the fundamental idea behind democracy?",
        "explain the concept of sustainability",
        "what are the main theories of personality in psychology?",
        "what is the philosophical concept of existentialism?",
        "explain the principles of quantum mechanics",
        "what is the theory of multiple intelligences?",
        "why do planes fly? Explain the principles of aerodynamics",
        "what is the concept of opportunity cost in economics?",
        "explain the philosophical idea of moral relativism",
        "what are the fundamental principles of design?",
    ],
    "contextual": [
        "how did the Great Depression influence American politics?",
        "what was the cultural context of Shakespeare's plays?",
        "how does the legal framework affect healthcare delivery?",
        "what is the political climate in Brazil right now?",
        "how does geographic location influence architectural styles?",
        "what was the social context of the Civil Rights Movement?",
        "how does the economic environment affect small businesses?",
        "what is the historical context of the French Revolution?",
        "how does organizational culture impact employee productivity?",
        "what's the technological landscape of renewable energy?",
        "how do market trends affect investment strategies?",
        "what is the regulatory environment for cryptocurrencies?",
        "how does the educational context differ between countries?",
        "what's the environmental context of sustainable agriculture?",
        "how does the social dynamic influence teenage behavior?",
    ],
}
